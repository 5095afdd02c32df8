"""Mixing documents to target domain weights, with soft domain membership.

A naive Bayes classifier over binned text statistics, fitted on the labelled rows, gives
every document a posterior over domains. Nonnegative document rates are then fitted so that
the expected token total of every domain, the sum of rate * tokens * posterior, meets its
target: least squares, projected on the least rate. A step needs only sums per domain and
pair of domains over all documents, and the rate of a document follows from its posterior
and one number per domain, so no vector of rates is ever kept or moved.

Everything over rows is SQL functions; the driver sees the bin counts and one row a step.

Defined cases: a null text is empty and has no tokens; a label row with a null label takes
no part; without labelled rows there is one domain and every rate is one; repeated rows are
rated each; extra columns are kept by ``mix`` and ignored by ``rates``; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import settle, whole_rows, whole_text

BINS = 16
# Weight of the rates' distance from one beside the targets' residuals.
RIDGE = 1e-6


def _log_bin(x: Column) -> Column:
    """Two bins for every doubling."""
    return F.floor(2 * F.log2(x + 1))


def _share_bin(part: Column, whole: Column) -> Column:
    """Finer towards zero: most shares of signs are small."""
    return F.floor(F.sqrt(part / F.greatest(whole, F.lit(1))) * BINS)


def _counted(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def text_statistics(text: Column) -> tuple[Column, list[Column]]:
    """Number of tokens (runs of other than white space) and the bins of a text."""
    chars = F.length(text)
    words = F.regexp_count(text, F.lit(r"\S+"))
    lines = _counted(text, "\n") + 1
    bins = [
        _log_bin(chars),
        _log_bin(lines),
        _log_bin(chars / lines),
        F.floor(chars / F.greatest(words, F.lit(1))),
        _share_bin(F.regexp_count(text, F.lit("[A-Z]")), chars),
        _share_bin(F.regexp_count(text, F.lit("[0-9]")), chars),
        _share_bin(_counted(text, "!"), chars),
        _share_bin(_counted(text, "|"), chars),
        _share_bin(_counted(text, "."), words),
        _share_bin(F.octet_length(text) - chars, chars),
    ]
    return words.cast("long"), [F.least(F.greatest(b, F.lit(0)), F.lit(BINS - 1)).cast("int") for b in bins]


def _with_statistics(docs: DataFrame) -> DataFrame:
    tokens, bins = text_statistics(F.col("_text"))
    return docs.withColumn("_text", whole_text()).withColumns(
        {"_tokens": tokens, "_bins": F.array(*bins)}
    )


@dataclass(frozen=True)
class Classifier:
    """Domains, their log priors, and log likelihoods by domain, statistic and bin."""

    domains: list[str]
    prior: list[float]
    likelihood: list[list[list[float]]]

    def posterior(self, bins: Column) -> list[Column]:
        if len(self.domains) == 1:
            return [F.lit(1.0)]
        logs = []
        for prior, table in zip(self.prior, self.likelihood, strict=True):
            score = F.lit(prior)
            for i, row in enumerate(table):
                # One literal: a list of numbers, cast once when the plan is made.
                values = F.split(F.lit(",".join(map(repr, row))), ",").cast("array<double>")
                score = score + F.element_at(values, bins[i] + 1)
            logs.append(score)
        scores = F.array(*logs)
        top = F.array_max(scores)
        total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
        return [F.exp(scores[k] - top) / total for k in range(len(logs))]


def fit_classifier(
    statistics: DataFrame, labels: DataFrame, label_columns: list[str], max_rows: int
) -> Classifier:
    """Naive Bayes over the bins of about ``max_rows`` labelled rows, drawn by hash."""
    domain = F.concat_ws("_", *[F.concat(F.lit(c), F.col(c).cast("string")) for c in label_columns])
    known = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in ["doc_id", *label_columns]))
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = statistics.join(
        drawn.select(F.col("doc_id").alias("_labelled"), domain.alias("domain")),
        F.col("doc_id") == F.col("_labelled"),
    )
    counts = (
        rows.select("domain", F.posexplode("_bins").alias("statistic", "bin"))
        .groupBy("domain", "statistic", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # domains * statistics * BINS rows at most
    )
    domains = sorted({r["domain"] for r in counts})
    if not domains:
        return Classifier(["all"], [0.0], [])
    width = 1 + max(r["statistic"] for r in counts)
    table = np.ones((len(domains), width, BINS))
    for r in counts:
        table[domains.index(r["domain"]), r["statistic"], r["bin"]] += r["n"]
    sizes = table[:, 0].sum(axis=1)
    return Classifier(
        domains,
        [float(x) for x in np.log(sizes / sizes.sum())],
        np.log(table / table.sum(axis=2, keepdims=True)).tolist(),
    )


@dataclass(frozen=True)
class Mixture:
    """A fitted classifier, the domains' pulls that give the rates, and the totals met."""

    classifier: Classifier
    pull: list[float]
    least_rate: float
    targets: list[float]
    reached: list[float]

    def rate(self, posterior: list[Column]) -> Column:
        return _projected(_pulled(self.pull, posterior), self.least_rate)


def _pulled(pull: list[float], posterior: list[Column]) -> Column:
    # One literal: compiled code is the same for all steps.
    values = F.split(F.lit(",".join(map(repr, pull))), ",").cast("array<double>")
    return sum((F.element_at(values, i + 1) * p for i, p in enumerate(posterior)), F.lit(0.0))


def _projected(move: Column, least_rate: float) -> Column:
    return F.greatest(F.lit(least_rate), F.lit(1.0) - move)


def fit_rates(
    scored: DataFrame,
    classifier: Classifier,
    weights: dict[str, float] | None,
    flatten: float,
    least_rate: float,
    tolerance: float = 1e-6,
    max_steps: int = 100,
) -> Mixture:
    """Rates over ``scored (tokens, p0, p1, ...)`` that meet the targets as nearly as can be.

    Targets are the given weights, or the domains' own token shares to the power
    ``flatten``, times the smallest total in which no domain has to shrink. The sum of
    squared residuals, in the metric of the inverse of the domains' Gram matrix, and
    ``RIDGE`` times the squared distance of the rates from one, in that of tokens, is least
    where every rate is ``max(least_rate, 1 - pull * posterior)`` for one pull a domain.
    The pulls are found on the convex dual by Newton steps that are halved until they gain,
    so no step is farther from the targets' optimum than the one before. Steps end when the
    residual or the gradient is within ``tolerance`` of the whole.
    """
    k = len(classifier.domains)
    ps = [F.col(f"p{i}") for i in range(k)]
    tokens = F.col("tokens")

    def sums(columns: dict[str, Column]) -> dict[str, float]:
        return scored.agg(
            *[F.coalesce(F.sum(tokens * c), F.lit(0.0)).alias(n) for n, c in columns.items()]
        ).first().asDict()

    def matrix(row: dict[str, float]) -> np.ndarray:
        return np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    products = {f"g{i}_{j}": ps[i] * ps[j] for i in range(k) for j in range(i, k)}
    row = sums(products | {f"s{i}": p for i, p in enumerate(ps)})
    gram, have = matrix(row), np.array([row[f"s{i}"] for i in range(k)])
    wanted = np.array(
        [have[i] ** flatten if weights is None else weights.get(d, 0.0) for i, d in enumerate(classifier.domains)]
    )
    wanted = np.where(have > 0, wanted, 0.0)
    if not wanted.sum() > 0:
        return Mixture(classifier, [0.0] * k, least_rate, [0.0] * k, have.tolist())
    wanted = wanted / wanted.sum()
    total = max(h / w for h, w in zip(have, wanted, strict=True) if w > 0)
    target = total * wanted

    def look(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The dual's value, gradient and curvature, and the totals reached."""
        move = _pulled(pull.tolist(), ps)
        free = F.greatest(F.lit(0.0), 1.0 - move - least_rate)
        row = sums(
            {n: F.when(free > 0, c).otherwise(0.0) for n, c in products.items()}
            | {f"s{i}": _projected(move, least_rate) * p for i, p in enumerate(ps)}
            | {"value": free * free / 2 - least_rate * move}
        )
        reached = np.array([row[f"s{i}"] for i in range(k)])
        value = row["value"] + target @ pull + RIDGE / 2 * pull @ gram @ pull
        slope = RIDGE * gram @ pull - reached + target
        return value, slope, matrix(row) + RIDGE * gram, reached

    pull = np.zeros(k)
    value, slope, curve, reached = look(pull)
    for _ in range(max_steps):
        if min(np.linalg.norm(reached - target), np.linalg.norm(slope)) < tolerance * total:
            break
        step = -np.linalg.lstsq(curve, slope, rcond=1e-12)[0]
        size = 1.0
        while size > 1e-6:
            found = look(pull + size * step)
            if found[0] <= value + 1e-4 * size * float(slope @ step):
                break
            size /= 2
        else:
            break  # no gain is left in doubles
        pull = pull + size * step
        value, slope, curve, reached = found
    return Mixture(classifier, pull.tolist(), least_rate, target.tolist(), reached.tolist())


def _copies(rate: Column) -> Column:
    """A whole number whose mean over documents is the rate, drawn by the document's hash."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    return F.floor(rate + draw).cast("int")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_columns: list[str],
    weights: dict[str, float] | None = None,
    flatten: float = 0.7,
    least_rate: float = 0.0,
    max_rows: int = 50_000,
) -> tuple[Mixture, DataFrame]:
    """The fitted mixture, and (doc_id, tokens, p0, ...) of every row of ``docs``.

    ``max_rows`` bounds the labelled rows (about that many, drawn by hash) of the
    classifier; the rates are fitted over all documents. Documents with the same bins have
    the same posterior and so the same rate: their tokens are summed before the steps.
    """
    statistics = settle(
        _with_statistics(docs.select("doc_id", "text")).select(
            "doc_id", F.col("_tokens").alias("tokens"), "_bins"
        )
    )
    classifier = fit_classifier(statistics, labels, label_columns, max_rows)
    posterior = [p.alias(f"p{i}") for i, p in enumerate(classifier.posterior(F.col("_bins")))]
    alike = settle(
        statistics.groupBy("_bins").agg(F.sum("tokens").alias("tokens")).select("tokens", *posterior)
    )
    mixture = fit_rates(alike, classifier, weights, flatten, least_rate)
    return mixture, statistics.select("doc_id", "tokens", *posterior)


def rates(docs: DataFrame, labels: DataFrame, label_columns: list[str], **options) -> DataFrame:
    """(doc_id, tokens, domain, posterior, rate, copies); domain is the likeliest one."""
    mixture, scored = fit(docs, labels, label_columns, **options)
    ps = [F.col(f"p{i}") for i in range(len(mixture.classifier.domains))]
    best = F.array_max(
        F.array(
            *[
                F.struct(p.alias("p"), F.lit(d).alias("domain"))
                for p, d in zip(ps, mixture.classifier.domains, strict=True)
            ]
        )
    )
    return (
        scored.withColumn("rate", mixture.rate(ps))
        .withColumn("_best", best)
        .select(
            "doc_id",
            "tokens",
            F.col("_best.domain").alias("domain"),
            F.col("_best.p").alias("posterior"),
            "rate",
            _copies(F.col("rate")).alias("copies"),
        )
    )


def mix(docs: DataFrame, labels: DataFrame, label_columns: list[str], **options) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says.

    Rates are worked out from the text in place, so texts don't move. The rated rows are
    written before they are repeated: a filter on the number of copies would otherwise be
    pushed below them and read every text again.
    """
    mixture, _ = fit(docs, labels, label_columns, **options)
    posterior = {f"_p{i}": p for i, p in enumerate(mixture.classifier.posterior(F.col("_bins")))}
    rated = settle(
        _with_statistics(whole_rows(docs))
        .withColumns(posterior)
        .select("_row", _copies(mixture.rate([F.col(p) for p in posterior])).alias("_copies"))
    )
    return (
        rated.where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("_row.*")
    )
