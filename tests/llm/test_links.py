"""Near-duplicates, repeated strings, sketches, search and the pipeline."""

import hashlib
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from xxhash import xxh64_intdigest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import documents, labels, prose, texts  # noqa: E402

import corpus_pipeline  # noqa: E402

from storyloom.llm import components, repeats, similar, simhash, sketches, topk  # noqa: E402


def _fingerprint(text):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if linked(a, values[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_near_duplicates_match_brute_force(spark):
    base = prose(21, 400)
    near = [base[:k] + "zz" + base[k + 2 :] for k in range(40, 1400, 61)]
    rows = sorted((r for r in texts() if r[0] is not None), key=lambda r: r[0]) + [(50 + i, t) for i, t in enumerate(near)]
    prints = [_fingerprint(t or "") for _, t in rows]
    roots = _roots(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    expected = sorted((rows[i][0], f"{p:016x}", min(rows[j][0] for j in range(len(rows)) if roots[j] == r)) for i, (p, r) in enumerate(zip(prints, roots)))
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    assert len({r.component_id for r in found}) < len({r.doc_id for r in found})


def test_dense_lists_lose_no_link():
    draw = np.random.default_rng(5)
    fps = np.unique((draw.integers(0, 1 << 12, 900).astype(np.uint64) << np.uint64(20)) | np.uint64(7 << 50))
    links = simhash.list_links(fps, 2)
    at = {int(x): i for i, x in enumerate(fps)}
    pairs = {(at[a], at[b]) for a, b in links}
    mine = _roots(range(len(fps)), lambda i, j: (i, j) in pairs or (j, i) in pairs)
    true = _roots([int(x) for x in fps], lambda a, b: (a ^ b).bit_count() <= 2)
    assert mine == true


def test_keep_one_row_of_each_group(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 8, 9, 10, 11, 12, 12, 13, 14]
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_similar_texts_are_found_whatever_their_bits(spark, monkeypatch):
    words = prose(31, 300).split()
    near = [" ".join([*words[:k], *(f"new{k}x{i}" for i in range(n)), *words[k + n :]]) for n in (5, 20, 26, 60) for k in range(10, 220, 30)]
    rows = [r for r in texts() if r[0] is not None] + [(500 + i, t) for i, t in enumerate(near)]
    shingles = [similar.shingle_set((t or "").encode(), 5) for _, t in rows]
    roots = _roots(shingles, lambda a, b: not len(a) + len(b) or 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))
    expected = sorted(min(rows[j][0] for j in range(len(rows)) if roots[j] == r) for r in set(roots))
    assert simhash.keep_one(documents(spark, rows)).count() > len(expected)  # too few bits
    for heads, heavy, least in (((2, 4, 16), 200, 16), ((1,), 6, 1)):
        monkeypatch.setattr(similar, "HEADS", heads)
        monkeypatch.setattr(similar, "HEAVY", heavy)
        monkeypatch.setattr(similar, "HEAVY_LEAST", least)
        kept = similar.keep_one(documents(spark, rows)).collect()
        assert sorted(r.doc_id for r in kept) == expected
    assert similar.keep_one(documents(spark, [])).count() == 0


def test_pipeline_stage_meets_fingerprints_in_the_positional_index(spark, monkeypatch):
    base = prose(21, 400)
    near = [base[:k] + "zz" + base[k + 2 :] for k in range(40, 1400, 161)]
    rows = [r for r in texts() if r[0] is not None] + [(50 + i, t) for i, t in enumerate(near)]
    met, pairs_of = [], similar._fingerprint_pairs

    def watched(marked, max_bits):
        prints = {r.node: r.fp for r in marked.where("key IS NULL").collect()}
        met.append((prints, pairs_of(marked, max_bits).collect()))
        return pairs_of(marked, max_bits)

    monkeypatch.setattr(similar, "_fingerprint_pairs", watched)
    assert corpus_pipeline.unique(spark, documents(spark, rows), "").count()
    prints, pairs = met[0]
    assert {p % 2**64 for p in prints.values()} == {simhash.fingerprint((t or "").encode(), 5) for _, t in rows}
    nodes = sorted(prints)
    linked = {(p.a, p.b) for p in pairs}
    mine = _roots(nodes, lambda a, b: (a, b) in linked or (b, a) in linked)
    assert mine == _roots(nodes, lambda a, b: ((prints[a] ^ prints[b]) % 2**64).bit_count() <= 2)
    assert linked


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (3, None), (5, 6)]
    found = components.component_roots(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 1) for i in range(1, 61)} | {(i, 100) for i in range(100, 140)}
    assert components.component_roots(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("length", [16, 400])
def test_repeats_match_brute_force(spark, length):
    rows = texts() + [(30 + i, prose(30 + i, 60) + texts()[0][1][i : i + 450]) for i in range(12)]
    rows += [(60, "abc" * 300 + prose(9, 30)), (61, "é" * 500)]
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, x in enumerate(data):
        for s in range(len(x) - length + 1):
            seen.setdefault(x[s : s + length], []).append((i, s))
    expected = []
    gone = [np.zeros(len(x), bool) for x in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = True
    for (i, _), x, g in zip(rows, data, gone):
        kept = np.frombuffer(x, np.uint8)[~g].tobytes()
        spans = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        expected.append((str(i), len(x), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    found = repeats.remove_repeats(documents(spark, rows), length).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(expected)
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_versions(spark):
    rows = [r for r in texts() if r[0] != 12]
    found = sketches.compare_versions(documents(spark, rows)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = []
    for at, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        expected.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(expected)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fingerprint == by_id[2].fingerprint != by_id[4].fingerprint
    assert by_id[1].near_next == 1.0
    assert 0.3 < by_id[10].near_edited < 0.7 and by_id[10].near_next < 0.05
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert sketches.compare_versions(documents(spark, [])).count() == 0
    alone = sketches.compare_versions(documents(spark, [(1, "One sentence. Two.")])).first()
    assert alone.near_next == 1.0


@pytest.mark.parametrize("cells", [2, 32])
def test_peeling_recovers_the_difference(spark, cells):
    draw = np.random.default_rng(2)
    keys = [int(x) << 20 | 5 for x in draw.integers(0, 1 << 43, 40)]
    pairs = spark.createDataFrame(
        [(0, 0, keys[:30], keys[10:]), (1, 0, keys[:3], keys[:3]), (2, 1, [], keys[:2])],
        "row bigint, pair int, one array<bigint>, other array<bigint>",
    )
    rows = {r.row: r for r in sketches.differing_characters(pairs, cells).collect()}
    assert 1 not in rows
    assert rows[2].chars == 10 and not rows[2].stuck
    if cells == 2:
        assert rows[0].stuck
    else:
        assert rows[0].chars == 5 * 20 and not rows[0].stuck
    assert {r.row: r.chars for r in sketches.differences(pairs).collect()} == {0: 100, 2: 10}


def test_top_k_matches_brute_force(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(80)]
    rows += [(80, None), (81, [1.0, None]), (82, [float("nan")] * 6), (83, [float("inf")]), (84, [1.0] * 3), (85, []), (None, [1.0])]
    rows += [(7, rows[7][1]), (90, rows[5][1]), (91, rows[5][1]), (20, [0.0] * 6)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    fit = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q in sorted({i for i, _ in fit if i % 10 == 0}):
        mine = max(v for i, v in fit if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in fit if i != q)
        expected += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:10])]
    for block in (3, 4096):
        found = topk.top_k(table, every=10, k=10, block_rows=block).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == expected
    assert topk.top_k(table.limit(0), every=10).count() == 0


def test_scores_beyond_64_bits_stay_in_bounds():
    big = np.array([[2**60, 2**60]])
    assert topk.accumulate(big, big)[0, 0] == 2**63 - 1
    assert topk.accumulate(big, -big)[0, 0] == -(2**63)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = texts() + [(200 + i, prose(200 + i, 50)) for i in range(40)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i % 3 > 0), 0) for i in range(200, 240)]
    labels(spark, marks).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {1, 4, 9, 10} | set(range(200, 240)) <= ids
        assert name == "toxicity" or not {2, 3} & ids
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
