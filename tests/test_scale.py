"""Operators on groups that hold most of the rows."""

from pyspark.sql import functions as F

from storyloom.operators.intake import first_per_key
from storyloom.operators.ranking import number_rows, positions, top_per_group


def _skewed(spark, n=3000):
    """One key holds a third of the rows, the rest is spread over a thousand."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 1000).cast("string"))
    return spark.range(n).select(key.alias("key"), (F.col("id") * 7 % n).alias("ordinal"))


def _expected(df):
    groups = {}
    for row in df.collect():
        groups.setdefault(row["key"], []).append(row["ordinal"])
    return {(k, o): i + 1 for k, os in groups.items() for i, o in enumerate(sorted(os))}


def test_positions_number_a_hot_group_over_many_slices(spark):
    df = _skewed(spark)
    got = positions(df, ["key"], width=50)
    assert {(r["key"], r["ordinal"]): r["position"] for r in got.collect()} == _expected(df)


def test_positions_with_a_leading_order(spark):
    df = spark.createDataFrame(
        [("a", 2, 0), ("a", 1, 90), ("a", 1, 5), (None, 1, 7)], "key string, major int, ordinal bigint"
    )
    got = positions(df, ["key"], major="major", width=10).collect()
    assert {(r["key"], r["ordinal"]): r["position"] for r in got} == {
        ("a", 5): 1, ("a", 90): 2, ("a", 0): 3, (None, 7): 1,
    }


def test_number_rows_is_dense_in_order(spark):
    df = _skewed(spark, 1000).repartition(7)
    got = number_rows(df, [F.col("ordinal")]).collect()
    assert sorted((r["ordinal"], r["position"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_top_per_group_beyond_the_pruned_size(spark):
    df = _skewed(spark, 6000)
    want = {k: p for k, p in _expected(df).items() if p <= 1500}
    got = top_per_group(df, ["key"], [F.col("ordinal")], 1500)
    assert {(r["key"], r["ordinal"]): r["rank"] for r in got.collect()} == want


def test_small_top_is_pruned_before_the_shuffle(spark):
    plan = top_per_group(_skewed(spark), ["key"], [F.col("ordinal")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_first_per_key(spark):
    df = _skewed(spark)
    got = {r["key"]: r["ordinal"] for r in first_per_key(df, ["key"]).collect()}
    assert got == {k: o for (k, o), p in _expected(df).items() if p == 1}


def test_large_and_small_k_give_the_same_rows(spark, monkeypatch):
    from storyloom.operators import ranking

    rows = spark.range(500).selectExpr("id % 3 AS k", "id", "(id * 37) % 101 AS v")
    order = [F.desc("v"), F.col("id")]
    small = sorted(map(tuple, ranking.top_per_group(rows, ["k"], order, 20).collect()))
    monkeypatch.setattr(ranking, "_PRUNED_K", 5)
    assert sorted(map(tuple, ranking.top_per_group(rows, ["k"], order, 20).collect())) == small


def _brute_first_fit(sets):
    clusters, out = [[]], []
    for words in sets:
        for number, members in enumerate(clusters):
            if all(words & other for other in members):
                break
        else:
            number = len(clusters)
            clusters.append([])
        clusters[number].append(words)
        out.append(number)
    return out


def _word_sets(n, seed):
    import random

    draw = random.Random(seed)
    return [tuple(sorted({f"w{int(draw.paretovariate(0.6)) % (3 * n)}" for _ in range(draw.randint(1, 4))})) for _ in range(n)]


def test_first_fit_of_five_thousand_labels_equals_brute_force():
    from storyloom.operators.merging import FirstFit

    sets = list(dict.fromkeys(_word_sets(5000, 3)))
    fit = FirstFit()
    assert [fit.place(words) for words in sets] == _brute_first_fit([frozenset(s) for s in sets])


def test_first_fit_time_grows_with_the_labels():
    import time

    from storyloom.operators.merging import FirstFit

    def seconds(n):
        # Reports name few places each, and places are many.
        sets = [(f"p{i % (n // 4)}", f"q{i * 7919 % n}") for i in range(n)]
        fit, start = FirstFit(), time.process_time()
        for words in sets:
            fit.place(words)
        return time.process_time() - start

    seconds(1000)
    assert seconds(50_000) < 40 * max(seconds(5000), 0.005)


def test_one_group_of_many_labels(spark):
    from storyloom.operators.merging import label_clusters

    labels = list(dict.fromkeys("fire " + " ".join(s) for s in _word_sets(3000, 5)))
    members = spark.createDataFrame([(0, i, t) for i, t in enumerate(labels)], "group_pos bigint, label_pos bigint, label string")
    got = label_clusters(members.repartition(3), generic=["fire"], stopwords=[])
    want = _brute_first_fit([frozenset(t.split()[1:]) for t in labels])
    assert {r["label"]: r["cluster"] for r in got.collect()} == dict(zip(labels, want, strict=True))


def test_a_hundred_thousand_names(spark):
    from storyloom.operators.locations import place_scores

    numbers = spark.range(50_000)
    name = F.concat(F.lit("place no. "), "id")
    gazetteer = numbers.select(
        F.col("id").alias("place_rank"), name.alias("label"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"),
        F.lit("local").alias("scope"), F.explode(F.array(name, F.concat(F.lit("(P"), "id"))).alias("alias"),
    )
    rows = spark.createDataFrame(
        [
            ("Place No. 7", "Place no. 12 and place no. 123456", "PLACE  NO. 49999."),
            ("other", "xplace no. 3, place no. 4x, (p5 (p6x x(p8 .(p9", None),
            ("none", None, None),
            ("Place No. 7", "place no. 12", ""),
        ],
        "canonical_label string, title string, description string",
    )
    got = place_scores(rows, gazetteer)
    assert {(r["canonical_label"], r["place_rank"], r["score"]) for r in got.collect()} == {
        ("Place No. 7", 7, 3), ("Place No. 7", 12, 1), ("Place No. 7", 49999, 1), ("other", 5, 1), ("other", 9, 1),
    }


def test_locations_read_articles_twice(spark, tmp_path):
    from storyloom.operators.locations import story_locations

    rows = spark.createDataFrame([("a", "Paris", "x", "Tech")], "canonical_label string, title string, description string, theme string")
    rows.write.parquet(str(tmp_path / "articles"))
    located = story_locations(spark.read.parquet(str(tmp_path / "articles")))
    plan = located._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
