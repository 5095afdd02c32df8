"""Centroid clusters, token files and hard negatives against brute force."""

import hashlib
import random
import sys
import tempfile
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import documents, prose, texts  # noqa: E402

from storyloom.llm import drift_clusters, hard_negatives, token_files  # noqa: E402
from storyloom.llm.shared import releasing, settle  # noqa: E402

VECTORS = "vec_id bigint, embedding array<float>, label int, weights string, cluster string, slot int, n bigint"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "w", "c", 1, 2) for i, v, l in rows], VECTORS)


def odd_vectors(width, n, seed):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0, 1) for _ in range(width)], i % 3) for i in range(n)]
    rows += [
        (None, [0.5] * width, 1),
        (n + 1, None, 1),
        (n + 2, [float("nan")] + [0.0] * (width - 1), 1),
        (n + 3, [float("inf")] + [0.0] * (width - 1), 1),
        (n + 4, [None] + [0.0] * (width - 1), 1),
        (n + 5, [], 1),
        (n + 6, [1.0] * (width - 1), 1),
        (n + 7, rows[3][1], None),
        rows[4],  # a row twice
        (rows[5][0], rows[6][1], rows[6][2]),  # an id twice
        (n + 8, rows[7][1], rows[7][2]),  # a tie
    ]
    return rows


def floors(row, scale):
    return [int(np.floor(np.float64(np.float32(x)) * scale)) for x in row]


def fits(row):
    return row is not None and all(x is not None and np.isfinite(x) for x in row)


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, floors(v, 64)) for i, v, _ in rows if fits(v) and len(v) == dims]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), w) for i, w in kept if i is not None)
    cents = [w for _, w in named[:k]]

    def nearest(w):
        d = [sum((a - b) ** 2 for a, b in zip(w, c, strict=True)) for c in cents]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        mine = [[] for _ in cents]
        for _, w in kept:
            mine[nearest(w)[0]].append(w)
        cents = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else c for m, c in zip(mine, cents, strict=True)]
    placed = [(i, c, min(d, 2**63 - 1)) for i, (c, d) in ((i, nearest(w)) for i, w in kept)]
    by = {c: sum(d for _, x, d in placed if x == c) for _, c, _ in placed}
    total = min(sum(by.values()), 2**63 - 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, min(by[c], 2**63 - 1), total, sha[c]) for i, c, d in placed), key=repr)


@pytest.mark.parametrize(("n", "k"), [(300, 16), (8, 30), (40, 1)])
def test_clusters_match_a_full_scan(spark, n, k):
    rows = odd_vectors(6, n, n)
    found = drift_clusters.clusters(vectors(spark, rows), k=k, dims=6).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_clusters(rows, k, 3, 6)


def test_clusters_of_huge_components_and_no_rows(spark):
    rows = [(i, [3e9 * (i % 5), -2e9, float(i)], 0) for i in range(20)]
    found = drift_clusters.clusters(vectors(spark, rows), k=3, dims=3).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_clusters(rows, 3, 3, 3)
    assert drift_clusters.clusters(vectors(spark, []), dims=3).collect() == []


def test_drift_is_bounded_by_less_than_itself():
    draw = np.random.default_rng(2)
    less = 0
    for _ in range(40):
        old = draw.normal(size=(4, 5)) * 3
        new = old + draw.normal(size=(4, 5)) * draw.choice([0.1, 1, 4])
        radii = draw.uniform(0, 2, 4)
        bound = drift_clusters.approach(old, new, radii)
        drift = np.linalg.norm(new - old, axis=1)
        less += int((bound < 0.95 * drift).sum())
        for i in range(4):
            away = draw.normal(size=(500, 5))
            away /= np.linalg.norm(away, axis=1)[:, None]
            x = old[i] + away * radii[i] * draw.uniform(0, 1, (500, 1)) ** 0.2
            for j in range(4):
                nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert nearer.max() <= bound[i, j] + 1e-9
    assert less > 200


def test_most_vectors_are_settled_without_a_scan(spark):
    draw = random.Random(9)
    centres = [[draw.gauss(0, 4) for _ in range(8)] for _ in range(16)]
    rows = [(i, [c + draw.gauss(0, 0.3) for c in centres[i % 16]], 0) for i in range(2000)]
    _, _, scanned = drift_clusters.fit(vectors(spark, rows), k=16, dims=8)
    assert scanned[0] == 2000 and scanned[-1] < 1000


def brute_negatives(rows, every):
    kept = [(i, (l + 1) % 10 if i % 7 == 0 else l, floors(v, 256)) for i, v, l in rows if i is not None and l is not None and fits(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, w in kept:
        if i % every:
            continue
        scored = sorted((-dot(w, x), j, l) for j, l, x in kept if j != i)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(s, j) for s, j, l in scored if l != label and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, positive, rank, j, -p, -s) for rank, (s, j) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_hard_negatives_match_brute_force(spark, block_rows):
    rows = odd_vectors(11, 200, 4)
    rows += [(300 + i, [0.25 * (i % 3)] * 11, i % 2) for i in range(30)]  # ties
    found = hard_negatives.mine_negatives(vectors(spark, rows), every=10, block_rows=block_rows).collect()
    expected = brute_negatives(rows, 10)
    assert sorted(tuple(r) for r in found) == expected and len(expected) > 100


def test_hard_negatives_of_no_rows(spark):
    assert hard_negatives.mine_negatives(vectors(spark, [])).collect() == []
    lonely = [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 2)]
    assert hard_negatives.mine_negatives(vectors(spark, lonely)).collect() == []


@pytest.mark.parametrize("largest", [1, 300, 2**31 - 1])
def test_lookups_are_inner_products(largest):
    draw = np.random.default_rng(largest)
    for width in (1, 8, 13, 64):
        anchors = draw.integers(-largest, largest + 1, (5, width))
        rows = draw.integers(-largest, largest + 1, (40, width))
        if largest < 400:
            expected = rows @ anchors.T
        else:  # within 64 bits only for short vectors
            anchors[:, 2:] = 0
            expected = rows[:, :2] @ anchors[:, :2].T
        assert (hard_negatives.table_scores(hard_negatives.subset_sums(anchors), rows) == expected).all()


def encode(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def expected_files(rows):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, np.array(encode(tokenizer, t), "<u4")) for i, t in rows]


def test_token_files_hold_every_document_in_order(spark):
    rows = [r for r in texts() if r[0] != 12]
    want = expected_files(rows)
    folder = tempfile.mkdtemp(prefix="spark-tokens-")
    manifest = token_files.write_tokens(documents(spark, rows), BYTE_BPE, folder)
    found = token_files.read_tokens(spark, folder, documents(spark, []).schema["doc_id"].dataType)
    found = sorted(found.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [i for i, _ in want]
    assert [bytes(r.ids) for r in found] == [ids.tobytes() for _, ids in want]
    starts = np.cumsum([0, *(len(ids) for _, ids in want)]).tolist()
    assert [r.start for r in found] == starts[:-1] and manifest["n_tokens"] == starts[-1]
    # The files alone, shard after shard, are all ids and all offsets.
    flat = b"".join((Path(folder) / f"tokens-{s['attempt']}.bin").read_bytes() for s in manifest["shards"])
    assert (np.frombuffer(flat, "<u2") == np.concatenate([ids for _, ids in want])).all()
    offsets = [np.fromfile(Path(folder) / f"offsets-{s['attempt']}.bin", "<u8")[:-1] for s in manifest["shards"]]
    assert np.concatenate(offsets).tolist() == starts[:-1]
    assert len(list(Path(folder).iterdir())) == 1 + 3 * len(manifest["shards"])


def test_token_digests_of_repeated_ids_and_no_rows(spark):
    folder = tempfile.mkdtemp(prefix="spark-tokens-")
    found = token_files.token_digests(documents(spark), BYTE_BPE, f"file://{folder}").collect()
    want = expected_files(texts())
    key = lambda x: repr(sorted(x, key=repr))
    assert key([(r.doc_id, r.n_tokens, r.ids_crc32) for r in found]) == key([(i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in want])
    by_start = sorted(found, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)]).tolist()[:-1]
    folder = tempfile.mkdtemp(prefix="spark-tokens-")
    assert token_files.token_digests(documents(spark, []), BYTE_BPE, folder).collect() == []


def test_a_damaged_file_is_an_error(spark):
    folder = tempfile.mkdtemp(prefix="spark-tokens-")
    manifest = token_files.write_tokens(documents(spark), BYTE_BPE, folder)
    name = Path(folder) / f"tokens-{manifest['shards'][0]['attempt']}.bin"
    name.write_bytes(name.read_bytes()[:-2])
    with pytest.raises(ValueError, match="disagree"):
        token_files.Shard(folder, manifest["shards"][0], manifest["dtype"])


def test_cached_pieces_give_the_tokenizers_ids():
    tokenizer, cached = Tokenizer.from_file(BYTE_BPE), token_files.ByteTokenizer(BYTE_BPE)
    draw = random.Random(3)
    signs = ["a", "Bc", "é", "ÿ", " ", "  ", "\n", "\t", "\r", "'s", "'", "'ll", "1", "23", ".", "!!", "-", "<|endoftext|>", "x" * 90]
    cases = ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(1500)]
    cases += [prose(5, 500), "東京 tower", "½ ª 1²", "\x1c \x85 \xa0 x", "Ġ Ġa", "a\x00b"]
    found = cached.encode(cases)
    for text, raw in zip(cases, found, strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_releasing_removes_all_but_what_is_kept(spark):
    kept = []
    with releasing(spark, kept):
        gone = settle(spark.range(3))
        kept.append(settle(gone.where("id > 0")))
        path = Path(gone.inputFiles()[0].removeprefix("file://")).parent
        assert path.exists()
    assert not path.exists() and kept[0].count() == 2
