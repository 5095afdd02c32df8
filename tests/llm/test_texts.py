"""Packing, language model, mixing, toxicity, pages and personal data."""

import hashlib
import math
import re
import sys
import zlib
from bisect import bisect_left, insort
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import documents, labels, prose, texts  # noqa: E402

from storyloom.llm import html_text, language_model, mixing, packing, pii, toxicity  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def _best_fit(lengths, limit):
    """Sequences that best-fit decreasing opens, piece by piece."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else limit
        insort(rooms, room - length)
    return len(rooms)


@pytest.mark.parametrize("limit", [64, 2048])
def test_packing_is_gapless_whole_and_tight(spark, limit):
    rows = packing.pack(documents(spark), PATH, limit).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc_id, text in texts():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            expected[doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(places) == _best_fit([r.length for r in rows], limit)


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_slots_cover_every_rank_once():
    draw = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(draw.integers(1, 101, 60), draw.integers(1, 500, 60))}
    used, ranks = Counter(), {n: [] for n in counts}
    for length, first, end, sequence, each, offset in packing.plan_slots(counts, 100):
        for rank in range(first, end):
            ranks[length].append(rank)
            used[sequence + (rank - first) // each] += length
            assert offset + ((rank - first) % each + 1) * length <= 100
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
    assert max(used.values()) <= 100
    assert len(used) == _best_fit([n for n, c in counts.items() for _ in range(c)], 100)


def test_language_model_base_and_probabilities(spark):
    rows = language_model.score_documents(documents(spark)).collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for i, t in texts()]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens]
    counts = Counter(w for (_, ws), h in zip(tokens, out) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), len(words), sum(counts[w] > 0 for w in words), h, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6))
        for (i, words), h in zip(tokens, out)
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in rows) == expected
    assert all(r.train_tokens == n and r.score < 0 for r in rows)
    assert language_model.score_documents(documents(spark, [])).count() == 0


def test_all_training_documents_are_trained_on(spark):
    docs = documents(spark, [(i, prose(i, 12)) for i in range(140)])
    counts = language_model.count_words(docs.where(~language_model.held_out()))
    found = language_model.training_sequences(docs, language_model.read_vocabulary(counts))
    assert found.count() == docs.where(~language_model.held_out()).count()
    assert {r["round"] for r in found.select("round").collect()} == set(range(language_model.ROUNDS))


def test_class_scores_follow_documents_whatever_the_lanes(monkeypatch):
    draw = np.random.default_rng(0)
    network = language_model.Network(language_model.Network.start(np.ones(language_model.CLASSES)))
    sizes = draw.integers(1, 200, 40)
    bounds = np.r_[0, np.cumsum(sizes)]
    classes = draw.integers(0, language_model.CLASSES, bounds[-1]).astype(np.uint8)
    whole = language_model.class_scores(network, classes, bounds)
    for a, b in zip(bounds, bounds[1:]):
        alone = language_model.class_scores(network, classes[a:b], np.array([0, b - a]))
        assert np.allclose(alone, whole[a:b], atol=1e-4)
    monkeypatch.setattr(language_model, "SCORE_WINDOW", 7)
    assert np.allclose(language_model.class_scores(network, classes, bounds), whole, atol=1e-4)


def test_gradients_match_differences():
    draw = np.random.default_rng(1)
    flat = language_model.Network.start(np.ones(language_model.CLASSES))
    inputs = draw.integers(0, language_model.CLASSES, (5, 3))
    targets = draw.integers(0, language_model.CLASSES, (5, 3))
    keep, h = np.ones((5, 3), np.float32), np.zeros((3, language_model.STATE), np.float32)
    keep[2, 1] = 0

    def loss(weights):
        network, state, total = language_model.Network(weights), h, 0.0
        for name in network.parts:
            network.parts[name] = network.parts[name].astype(float)
        for t in range(5):
            state = network.step(network.parts["x"][inputs[t]], state * keep[t][:, None])[0]
            total -= network.log_probabilities(state, targets[t]).sum()
        return total / 15

    found, _ = language_model.Network(flat).gradients(
        inputs, keep, targets, np.full((5, 3), 1 / 15, np.float32), h
    )
    found = np.concatenate([found[n].ravel() for n in language_model.Network.SHAPES])
    for at in np.argsort(-np.abs(found))[::150][:25]:
        step = np.zeros(len(flat))
        step[at] = 1e-4
        slope = (loss(flat + step) - loss(flat - step)) / 2e-4
        assert found[at] == pytest.approx(slope, rel=0.05, abs=1e-4)


def test_training_steps_skip_no_token(monkeypatch):
    counted = []
    real = language_model.Network.gradients

    def gradients(self, inputs, keep, targets, weights, h):
        counted.append((targets[weights > 0], weights.sum()))
        return real(self, inputs, keep, targets, weights, h)

    monkeypatch.setattr(language_model.Network, "gradients", gradients)
    for n in (1, 63, 64, 65, 20_011):
        counted.clear()
        sequence = np.random.default_rng(n).integers(0, language_model.CLASSES, n).astype(np.uint8)
        network = language_model.Network(language_model.Network.start(np.ones(language_model.CLASSES)))
        language_model.train_lanes(network, sequence)
        assert sorted(np.concatenate([c for c, _ in counted]).tolist()) == sorted(sequence.tolist())
        assert all(total == pytest.approx(1) for _, total in counted)


def test_mixing_meets_targets(spark):
    rows = [(i, prose(i, 30 + i % 50) if i % 4 else prose(i, 20).upper() + "!!!") for i in range(120)]
    marks = labels(spark, [(i, int(i % 4 > 0), None) for i in range(0, 120, 2)])
    docs = documents(spark, rows)
    mixture, _ = mixing.fit(docs, marks, ["quality"], weights={"quality0": 0.4, "quality1": 0.6})
    assert mixture.reached == pytest.approx(mixture.targets, rel=1e-3)
    found = mixing.rates(docs, marks, ["quality"], flatten=0.5).collect()
    assert len(found) == 120 and all(r.rate >= 0 and abs(r.copies - r.rate) <= 1 for r in found)
    right = sum(r.domain == f"quality{int(r.doc_id % 4 > 0)}" for r in found)
    assert right > 115
    kept = mixing.mix(docs, marks, ["quality"], flatten=0.5, least_rate=1.0)
    assert kept.columns == docs.columns
    assert kept.select("doc_id").distinct().count() == 120


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_are_as_near_as_a_converged_solver(spark, least):
    draw = np.random.default_rng(11)
    p = draw.dirichlet([0.3] * 3 + [0.05], 400)
    tokens = draw.integers(1, 300, 400).astype(float)
    scored = spark.createDataFrame([(t, *map(float, q)) for t, q in zip(tokens.tolist(), p)], "tokens double, p0 double, p1 double, p2 double, p3 double")
    known = mixing.Classifier(list("abcd"), [0.0] * 4, [])
    mixture = mixing.fit_rates(scored, known, None, 0.3, least)
    target, inverse = np.array(mixture.targets), np.linalg.inv((p.T * tokens) @ p)
    rate, errors = np.ones(400), []
    for _ in range(50_000):
        residual = (tokens * rate) @ p - target
        errors.append(float(residual @ inverse @ residual))
        rate = np.maximum(least, rate - p @ (inverse @ residual))
    residual = np.array(mixture.reached) - target
    assert residual @ inverse @ residual <= 1.001 * min(errors) + 1e-4 * errors[0]
    assert errors[0] > 10 * min(errors)
    rates = [r.rate for r in scored.select(mixture.rate([scored[f"p{i}"] for i in range(4)]).alias("rate")).collect()]
    assert min(rates) >= least
    assert (tokens * rates) @ p == pytest.approx(mixture.reached)


def test_mixing_without_labels_or_rows(spark):
    docs = documents(spark)
    assert mixing.mix(docs, labels(spark), ["quality"]).count() == docs.count()
    assert mixing.mix(documents(spark, []), labels(spark), ["quality"]).count() == 0
    assert all(r.rate == 1.0 for r in mixing.rates(docs, labels(spark), ["quality"]).collect())


def test_toxicity_learns_words_and_beginnings(spark):
    rows = []
    for i in range(300):
        text = prose(i, 40)
        if i % 5 == 0:
            text += " you zonk. " if i % 2 else f" grumblex{i % 7} and grumbley{i % 3} here"
        rows.append((i, text))
    marks = labels(spark, [(i, None, int(i % 5 == 0)) for i in range(300)])
    found = toxicity.scores(documents(spark, rows), marks).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark)
    assert toxicity.scores(docs, labels(spark)).count() == docs.count()
    kept = toxicity.keep_clean(docs, labels(spark))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.scores(documents(spark, []), labels(spark)).count() == 0


def test_grammar_weighs_clauses():
    import pyarrow as pa

    def total(text):
        return toxicity.Reader({"zonk": 2.0}).features(pa.array([text]))[0, 0]

    assert total("you zonk") > total("a zonk") > total("not a zonk") > 0
    assert total("they said a zonk") < total("a zonk")
    assert total("i will kill you") > total("i will kill it") > 0
    assert total("you went. a zonk") == pytest.approx(total("a zonk"))
    assert total("nothing here") == 0


PAGES = [
    ("<title>t</title><nav><a>m</a></nav><article><h1>A &amp; B</h1><p><b>one<br><p>two &lt;3 </p></article><footer>f</footer>", "A & B\none\ntwo <3"),
    ("a<article>b</article>c", "b"),
    ("<article>x<nav>no<div>no</div></nav>y<div class='ad box'>no<p>no</div><p>z</article>", "x\ny\nz"),
    ("<main><script>var a='</p>';</script><p>k&eacute;<!-- <p>no</p> --></main><aside>no</aside>", "ké"),
    ("<div><p>" + "long text here " * 10 + "</p><ul><li><a href=x>menu</a></ul></div>", ("long text here " * 10).strip()),
    ("<article><p>text</p><div id='comments'><p>reader</p></div></article>", "text"),
    ("<p title='a>b'>q</p>", "q"),
    (None, ""),
    ("", ""),
    ("<nav>only</nav>", ""),
    ('<html class="no-js has-popup"><body class="has-sidebar sidebar"><p>One line.</p></body>', "One line."),
    ('<article class="post no-comments related"><div class="post-header header"><h1>Title</h1></div><p>Text.</p><div class="comments">No</div></article>', "Title\nText."),
    ('<main id="search-results"><p title="the hidden city">A</p><div class="x hidden lg:block">B</div><p hidden>C</p><p hidden="">D</p></main>', "A\nB"),
]


def test_main_text_of_pages(spark):
    rows = [(i, f"u{i}", html, "x") for i, (html, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html_text.extract(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.text == PAGES[r.page_id][1]
        assert r.n_chars == len(r.text)
    assert html_text.extract(pages.limit(0)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _base_spans(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def test_personal_data_spans(spark):
    odd = [
        "a@b.c_x@d.e.f a@@b.c x@y z@w.v-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1..2.3.4",
        "4111-1111-1111-1111 4111  1111 411111111111111112 0000000000000000", "+1 (2) 3-4.5 67890 +12+345678901",
        "é@ü.com ñ+x@y.z\U0001f600 1.1.1.1", "a@b.c\n\n\n9.9.9.9\n+49 30 1234567", "1" * 5000, "a" * 5000 + "@", "+" * 50 + "1" * 20,
        "DE89370400440532013000 and DE89370400440532013001", "password = abcd1234efgh",
    ]
    rows = texts() + [(100 + i, t) for i, t in enumerate(odd)]
    found = pii.report(documents(spark, rows)).collect()
    expected = Counter(hashlib.sha256(",".join(_base_spans(t or "")).encode()).hexdigest() for _, t in rows)
    assert Counter(r.base_sha256 for r in found) == expected
    by_id = {r.doc_id: r for r in found}
    for i, text in rows:
        if i is not None and i >= 100:
            listed = [s for s in by_id[i].spans.split(",") if s]
            assert [s for s in listed if s.split(":")[0] in BASE] == _base_spans(text)
    assert by_id[109].spans.count("iban") == 1
    assert "secret" in by_id[110].spans
    assert pii.report(documents(spark, [])).count() == 0


def test_masking_keeps_everything_else(spark):
    docs = documents(spark)
    masked = pii.mask(docs)
    assert masked.dtypes == docs.dtypes
    by_id = {r.doc_id: r for r in masked.collect() if r.doc_id not in (None, 12, 13)}
    assert by_id[9].text == "mail me at <EMAIL> or call <PHONE>, card <CARD>."
    assert by_id[9].n_chars == len(by_id[9].text)
    assert by_id[5].text is None and by_id[6].text == "" and by_id[1].text == texts()[0][1]
    assert by_id[9]._text == "a" and by_id[9]._row == "b"


def test_parts_named_by_several_words_go_and_wrappers_stay():
    body = "<p>Body text that counts.</p>"
    for gone in ("user-comments", "ad-slot", "cookie-banner", "comment-list", "comments_area", "related-box", "left-sidebar", "share-buttons", "site-nav"):
        page = f"<body><article>{body}<div class='x {gone}'><p>Not this.</p></div></article></body>"
        assert html_text.main_text(page) == "Body text that counts.", gone
    for kept in ("post-header", "has-sidebar", "no-comments", "content-with-sidebar", "search-results", "share-price", "ad-free", "header", "story-body", "related"[:4]):
        page = f"<body class='has-sidebar'><article class='no-comments'><div id='{kept}'>{body}</div></article></body>"
        assert html_text.main_text(page) == "Body text that counts.", kept


def test_generated_pages_give_back_their_articles():
    import random

    draw = random.Random(8)
    boxes = ["nav", "footer", "aside", "header", "div class='cookie-notice'", "div id='comments'", "div class='promo-box'", "section class='reader_comments'"]
    for n in range(60):
        blocks = [prose(1000 * n + i, draw.randint(4, 60)) for i in range(draw.randint(1, 9))]
        inside = [f"<p>{b}</p>" for b in blocks]
        for _ in range(draw.randint(0, 4)):
            box = draw.choice([b for b in boxes if b != "header"])
            inside.insert(draw.randint(0, len(inside)), f"<{box}><p>{prose(n, 20)}</p></{box.split()[0]}>")
        around = [f"<{b}><a href='#'>{prose(n, 5)}</a></{b.split()[0]}>" for b in boxes]
        page = f"<html><body>{''.join(around[:4])}<main>{''.join(inside)}</main>{''.join(around[4:])}</body></html>"
        assert html_text.main_text(page) == "\n".join(blocks)
