"""State tables: transactions, change files, merging, schema versions, and story days."""

import random
from pathlib import Path

import pytest
from helpers import labeled
from pyspark.sql import functions as F

from storyloom.plans.tracking import load_history, save_texts, save_tracking, track, whole_history
from storyloom.sources.state import ConcurrentRunError, SchemaError, StateStore, check_schema

TABLES = {
    "notes": ("key string, note string, size int", ["key"]),
    "days": ("id bigint, date date, note string", []),
    "log": ("id bigint", []),
}


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "state"), tables=TABLES)


def _notes(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, note string, size int")


def _read(store, name="notes"):
    return sorted(tuple(r) for r in store.read(name).collect())


def _folders(store, name="notes"):
    return {p.name for p in Path(store.root, name).glob("attempt=*")}


def test_a_small_change_writes_only_its_own_folder(spark, store):
    store.replace_keys("notes", _notes(spark, *((f"k{i}", "old " * 9, i) for i in range(500))))
    before = _folders(store)
    files = {p: p.stat().st_mtime_ns for p in Path(store.root, "notes").rglob("*.parquet")}
    store.replace_keys("notes", _notes(spark, ("k7", "new", 1)), _notes(spark, ("k8", None, None), ("k9", None, None)))
    assert len(_folders(store) - before) == 1
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    rows = {r[0]: r[1] for r in _read(store)}
    assert len(rows) == 498 and rows["k7"] == "new" and "k8" not in rows
    store.replace_keys("notes", _notes(spark, ("k8", "back", 1), ("k7", "newer", 1), ("k7", "twice", 2)))
    rows = _read(store)
    assert len(rows) == 500 and [r[1] for r in rows if r[0] in ("k7", "k8")] == ["newer", "twice", "back"]


def test_changes_are_merged_when_they_outgrow_the_base(spark, store):
    store.max_changes = 3
    store.change_share = 1e9
    want = {}
    draw = random.Random(1)
    for step in range(9):
        new = {f"k{draw.randrange(12)}": f"v{step}" for _ in range(3)}
        gone = {f"k{draw.randrange(12)}" for _ in range(2)}
        store.replace_keys(
            "notes",
            _notes(spark, *((k, v, step) for k, v in new.items())),
            _notes(spark, *((k, None, None) for k in gone)),
        )
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert {r[0]: r[1] for r in _read(store)} == want
        assert sum("keys" in p for p in store.parts("notes")) <= 3
    store.change_share = 0.01
    store.replace_keys("notes", _notes(spark, ("k1", "last", 0)))
    assert len(store.parts("notes")) == 1 and dict(r[:2] for r in _read(store)) == want | {"k1": "last"}


def test_changes_by_other_keys_apply_in_turn(spark, store):
    store.replace_keys("notes", _notes(spark, ("a", "x", 1), ("b", "y", 2), ("c", "z", 3)))
    store.replace_keys("notes", _notes(spark, ("d", "two", 2)), keys=["size"])
    store.replace_keys("notes", _notes(spark, ("c", "three", 2)))
    assert _read(store) == [("a", "x", 1), ("c", "three", 2), ("d", "two", 2)]


@pytest.mark.parametrize("died_after", range(4))
def test_a_run_that_dies_leaves_the_view_of_before(spark, store, died_after):
    days = spark.createDataFrame([(1, "one"), (2, "two")], "id bigint, note string")

    def writes(note):
        yield lambda: store.replace_date("days", days.withColumn("note", F.lit(note)), "2026-04-18")
        yield lambda: store.replace_keys("notes", _notes(spark, ("k", note, 1)))
        yield lambda: store.append("log", spark.range(1))
        yield lambda: store.set_counter("id", len(note))

    with store.transaction():
        for write in writes("old"):
            write()
    before = _read(store, "days"), _read(store), _read(store, "log"), store.counter("id")

    class Killed(BaseException):
        pass

    with pytest.raises(Killed), store.transaction():
        for i, write in enumerate(writes("newer")):
            write()
            if i == died_after:
                raise Killed
    again = StateStore(spark, store.root, tables=TABLES)
    assert (_read(again, "days"), _read(again), _read(again, "log"), again.counter("id")) == before
    assert again.vacuum(keep=1)  # what the dead run left
    assert (_read(again, "days"), _read(again), _read(again, "log"), again.counter("id")) == before


def test_of_two_runs_at_once_the_second_fails(spark, store):
    other = StateStore(spark, store.root, tables=TABLES)
    with pytest.raises(ConcurrentRunError), store.transaction():
        store.append("log", spark.range(2))
        other.append("log", spark.range(1))
    assert _read(store, "log") == [(0,)]
    assert not [n for n in store._names(f"{store.root}/_manifests") if n.startswith("new-")]


def test_dates_are_replaced_and_pruned(spark, store):
    rows = spark.createDataFrame([(i, f"2026-04-{10 + i:02d}", "n") for i in range(5)], "id bigint, date string, note string")
    rows = rows.withColumn("date", F.col("date").cast("date"))
    store.replace_dates("days", rows)
    store.replace_date("days", rows.limit(0), "2026-04-12")
    store.replace_date("days", rows.where("id = 1").withColumn("id", F.lit(9)), "2026-04-11")
    assert [r[0] for r in _read(store, "days")] == [0, 3, 4, 9]
    window = store.read("days", since="2026-04-11", before="2026-04-14")
    assert sorted(r["id"] for r in window.collect()) == [3, 9]
    assert all("date=2026-04-11" in f or "date=2026-04-13" in f for f in window.inputFiles())
    plan = store.read("days").where("date = date'2026-04-13'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_two_generations_are_read_as_one(spark, store):
    store.replace_keys("notes", _notes(spark, ("a", "x", 1), ("b", "y", None)))
    wider = {**TABLES, "notes": ("key string, note string, size bigint, extra array<string>", ["key"])}
    new = StateStore(spark, store.root, tables=wider, change_share=1e9)
    row = spark.createDataFrame([("b", "z", 1 << 40, ["e"])], wider["notes"][0])
    new.replace_keys("notes", row)
    assert sorted(map(tuple, new.read("notes").collect())) == [("a", "x", 1, None), ("b", "z", 1 << 40, ["e"])]
    with pytest.raises(SchemaError, match="size is stored as bigint"):
        store.read("notes")
    gone = {**TABLES, "notes": ("key string, size bigint, extra array<string>", ["key"])}
    with pytest.raises(SchemaError, match="note is not declared"):
        StateStore(spark, store.root, tables=gone).read("notes")


@pytest.mark.parametrize(("stored", "declared", "fits"), [
    ("a int", "a bigint", True), ("a int", "a double", True), ("a bigint", "a int", False),
    ("a float", "a double", True), ("a date", "a timestamp_ntz", True), ("a string", "a int", False),
])
def test_wider_types(stored, declared, fits):
    from pyspark.sql import types as T

    stored, declared = (T.StructType.fromDDL(x) for x in (stored, declared))
    if fits:
        check_schema("t", stored, declared)
    else:
        with pytest.raises(SchemaError):
            check_schema("t", stored, declared)


def _prior_rows(history, ids, day):
    rows = history.prior(ids, day).collect()
    key = lambda r: (r["story_id"], r["previous_count"], r["memory"], r["recent_articles"])
    return sorted((repr(key(r)) for r in rows))


def test_story_days_know_what_the_tables_know(spark, tmp_path):
    """Days in order, a rebuilt day, a day put between, one that lost its stories."""
    store = StateStore(spark, str(tmp_path / "state"))
    draw = random.Random(4)
    labels = ["Mali attacks", "Budget vote", "Kyiv talks", "Flood relief"]
    steps = ["2026-03-01", "2026-03-05", "2026-03-09", "2026-04-20", "2026-03-05", "2026-03-07", "2026-04-01"]
    for step, day in enumerate(steps):
        wanted = draw.sample(labels, draw.choice([1, 2, 3]))
        rows = [(100 * step + i, draw.choice(wanted), draw.choice("AB"), "Tech", 3) for i in range(5)]
        old, new = whole_history(store), load_history(store)
        ids = store.read("stories").select("story_id")
        shared = old.same_label(day).collect()
        assert sorted(shared) == sorted(new.same_label(day).select("canonical_label", "label_id").collect())
        assert sorted(old.recent(day).collect()) == sorted(new.recent(day).collect())
        alive = ids.where(F.col("story_id").isin([r["label_id"] for r in shared]))
        assert _prior_rows(old, alive, day) == _prior_rows(new, alive, day)
        out = track(labeled(spark, *rows), new, day)
        save_tracking(store, out, day)
        if step % 2 == 0:
            texts = out.stories.limit(1).select(
                "observation_id", F.lit(f"summary {step}").alias("summary"), F.lit("").alias("delta_summary")
            )
            save_texts(store, texts, day)


def test_a_run_of_today_reads_only_its_window(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    for day in ("2026-01-01", "2026-04-10"):
        save_tracking(store, track(labeled(spark, (1, "Mali attacks", "A", "Tech", 3)), load_history(store), day), day)
    history, ids = load_history(store), spark.range(3).select(F.col("id").alias("story_id"))
    for rows in (history.recent("2026-04-12"), history.same_label("2026-04-12"), history.prior(ids, "2026-04-12")):
        assert rows.inputFiles() and all("date=2026-04-10" in f for f in rows.inputFiles())
