"""The daily run: one ``spark-submit`` for one date.

    spark-submit --py-files storyloom.zip storyloom/plans/daily.py --today 2026-05-02 \\
        --feeds /landed/feeds --replies /landed/replies --state /state --out /reports

Replies are landed as JSON lines under ``<replies>/{labels,groups,matches,claims,
briefings,retries}``; a missing folder means no replies of that kind.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.tables import missing_payloads
from storyloom.plans import briefing as briefing_plan
from storyloom.plans import digest as digest_plan
from storyloom.plans.claims import ground_claims, save_claims, story_claims
from storyloom.plans.edition import edition_counts, edition_rows
from storyloom.plans.ingest import ingest
from storyloom.plans.labels import label, label_requests
from storyloom.plans.tracking import (
    Tracked,
    load_history,
    match_requests,
    save_texts,
    save_tracking,
    track,
    tracking_counters,
)
from storyloom.plans.tracking import label_requests as group_requests
from storyloom.session import cut, job_session
from storyloom.sources.feeds import read_feeds
from storyloom.sources.replies import (
    briefing_replies,
    group_replies,
    match_replies,
    reply_rejects,
)
from storyloom.sources.sinks import write_daily_snapshot, write_lines, write_rows
from storyloom.sources.state import StateStore

_CATALOGUE = "source_rank bigint, source string, language string, url string"
_REPLY = "reply_no bigint, article_id string, reply string"


@dataclass
class Replies:
    """Reply tables of a run, each with (reply_no, reply) and for claims article_id."""

    labels: DataFrame
    groups: DataFrame
    matches: DataFrame
    claims: DataFrame
    briefings: DataFrame
    retries: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str | None) -> Replies:
        def table(name: str) -> DataFrame:
            empty = spark.createDataFrame([], _REPLY)
            if path is None:
                return empty
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            if not folder.getFileSystem(conf).exists(folder):
                return empty
            return spark.read.schema(_REPLY).json(f"{path}/{name}")

        names = ["labels", "groups", "matches", "claims", "briefings", "retries"]
        return Replies(*[table(name) for name in names])

    def rejects(self) -> DataFrame:
        """Replies that could not be read, with their kind and the reason."""
        lists = {"labels": "results", "groups": "groups", "matches": "matches",
                 "claims": "claims", "briefings": "briefings", "retries": "briefings"}
        found = [
            reply_rejects(getattr(self, kind), key).select(
                F.lit(kind).alias("kind"), "reply_no", "article_id", "reject_reason"
            )
            for kind, key in lists.items()
        ]
        return reduce(DataFrame.unionByName, found)


class UnreadableReplies(ValueError):
    """Replies of a kind the run can't do without are not what was asked for."""


# Claims that can't be read only leave their article without claims.
FATAL_KINDS = ["labels", "groups", "matches", "briefings", "retries"]


def check_replies(rejects: DataFrame, shown: int = 20) -> None:
    """Stop a run whose replies can't be read; the first few are named."""
    order = ["kind", "reply_no", "reject_reason"]
    bad = rejects.where(F.col("kind").isin(FATAL_KINDS)).orderBy(*order).limit(shown).collect()
    if bad:
        raise UnreadableReplies("; ".join(f"{r['kind']} {r['reply_no']}: {r['reject_reason']}" for r in bad))


def store_day(
    items: DataFrame,
    store: StateStore,
    replies: Replies,
    today: str,
    cap: int | None = None,
    pages: DataFrame | None = None,
    snapshots: str | None = None,
    with_claims: bool = False,
    run_reports: str | None = None,
) -> Tracked:
    """Ingest, label, track and (optionally) ground claims; state is written.

    Under ``run_reports`` go what was skipped, rejected and counted, and the requests whose
    replies the next run of the date can use.
    """
    ingested = ingest(items, today, cap, pages)
    # The date of every item is parsed for it; labels read it several times.
    articles = cut(ingested.articles)
    labeled = label(articles, store.read("article_labels"), replies.labels)
    batch = cut(labeled.labeled)
    history = load_history(store)
    if run_reports:
        labels = batch.groupBy("story_label").agg(F.min("ordinal").alias("first_ordinal"))
        skips = ingested.skips.orderBy(F.desc("items"), "skip_reason", "source")
        write_rows(skips, f"{run_reports}/skips")
        write_rows(label_requests(labeled.misses), f"{run_reports}/label_requests")
        write_rows(group_requests(labels), f"{run_reports}/group_requests")
        write_rows(match_requests(labels, history.recent(today)), f"{run_reports}/match_requests")
    store.replace_keys("article_labels", labeled.new_cache_rows)
    if snapshots:
        write_daily_snapshot(batch, snapshots, today)
    tracked = track(
        batch,
        history,
        today,
        group_replies(replies.groups),
        match_replies(replies.matches),
    )
    # The context is kept per story; repeated on every article it would be most of the batch.
    tracked.articles = cut(tracked.articles.drop("previous_context"))
    if run_reports:
        write_rows(tracking_counters(tracked.stories), f"{run_reports}/tracking_counters")
    save_tracking(store, tracked, today)
    if with_claims:
        run = ground_claims(
            tracked.articles,
            store.read("claims"),
            store.read("claim_extractions"),
            replies.claims,
        )
        if run_reports:
            write_rows(run.counters(), f"{run_reports}/claim_counters")
            wanted = run.misses.select("article_id", "story_id", "content")
            write_rows(wanted, f"{run_reports}/claim_requests")
        save_claims(store, run)
    return tracked


def report_day(
    tracked: Tracked,
    store: StateStore,
    replies: Replies,
    today: str,
    out: str,
    n: int = 3,
    digest: bool = True,
    briefing: bool = True,
    edition: bool = True,
    show_evidence: bool = False,
    generated_at: str | None = None,
) -> None:
    """Write the reports under ``out`` and remember the texts of displayed stories."""
    generated_at = generated_at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M")
    stamp = generated_at.replace("-", "").replace(":", "").replace(" ", "_")
    articles = tracked.articles
    if digest:
        lines = digest_plan.digest_lines(articles, generated_at)
        write_lines(
            lines, f"{out}/digest_{stamp}.md", [F.col(c) for c in digest_plan.LINE_ORDER]
        )
    if not (briefing or edition):
        return
    picked = cut(briefing_plan.briefing_stories(articles, n, contexts=tracked.contexts()))
    claims = None
    if show_evidence:
        shown = picked.select("story_id")
        claims = story_claims(store.read("claims"), store.read("articles"), stories=shown)
    requests = briefing_plan.briefing_requests(articles, picked, claims)
    write_rows(requests, f"{out}/requests_{stamp}")
    first = briefing_replies(replies.briefings)
    write_rows(missing_payloads(picked, first).select("canonical_label"), f"{out}/missing_{stamp}")
    filled = cut(briefing_plan.fill_texts(picked, first, briefing_replies(replies.retries)))
    save_texts(store, briefing_plan.story_memories(filled), today)
    if briefing:
        lines = briefing_plan.briefing_lines(filled, articles, generated_at, claims)
        order = [F.col(c) for c in briefing_plan.LINE_ORDER]
        write_lines(lines, f"{out}/briefing_{stamp}.md", order)
        write_rows(filled, f"{out}/report_rows_{stamp}")
    if edition:
        rows = cut(edition_rows(filled, articles))
        write_rows(rows, f"{out}/edition_{stamp}")
        write_rows(edition_counts(rows), f"{out}/counts_{stamp}")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Track the stories of one day.")
    parser.add_argument("--today", default=None, help="run date, yyyy-mm-dd")
    parser.add_argument("--feeds", required=True, help="folder of landed feed files")
    parser.add_argument(
        "--catalogue", default=None,
        help="JSON lines (source_rank, source, language, url) instead of the built-in feeds",
    )
    parser.add_argument("--pages", default=None, help="Parquet of landed pages (url, html)")
    parser.add_argument("--replies", default=None, help="folder of landed replies")
    parser.add_argument("--state", required=True, help="folder of the state tables")
    parser.add_argument("--scratch-state", default=None, help="use this empty state instead")
    parser.add_argument("--out", required=True, help="folder of the reports")
    parser.add_argument("--max-per-source", type=int, default=None)
    parser.add_argument("--top-developments", type=int, default=3)
    parser.add_argument("--skip-digest", action="store_true")
    parser.add_argument("--skip-briefing", action="store_true")
    parser.add_argument("--skip-edition", action="store_true")
    parser.add_argument("--show-evidence", action="store_true")
    parser.add_argument(
        "--allow-bad-replies", action="store_true",
        help="go on where label, group, match or briefing replies can't be read",
    )
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    today = args.today or datetime.now(timezone.utc).strftime("%Y-%m-%d")
    spark = job_session()
    store = StateStore(spark, args.scratch_state or args.state)
    replies = Replies.read(spark, args.replies)
    catalogue = None
    if args.catalogue:
        catalogue = spark.read.schema(_CATALOGUE).json(args.catalogue)
    run_reports = f"{args.out}/run_{today}"
    # All that can stop the run comes before the first write to the state.
    rejects = cut(replies.rejects())
    write_rows(rejects, f"{run_reports}/rejects")
    if not args.allow_bad_replies:
        check_replies(rejects)
    items, unread = read_feeds(spark, args.feeds, catalogue)
    write_rows(unread, f"{run_reports}/feed_rejects")
    tracked = store_day(
        items,
        store,
        replies,
        today,
        args.max_per_source,
        None if args.pages is None else spark.read.parquet(args.pages),
        f"{store.root}/snapshots",
        args.show_evidence,
        run_reports,
    )
    report_day(
        tracked,
        store,
        replies,
        today,
        args.out,
        args.top_developments,
        digest=not args.skip_digest,
        briefing=not args.skip_briefing,
        edition=not args.skip_edition,
        show_evidence=args.show_evidence,
    )
    store.vacuum()


if __name__ == "__main__":
    main()
