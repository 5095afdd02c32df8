"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes (insult, threat, target, negation, reported speech, other). Small
transducers for insults, threats, targets, negation and reported speech are composed into
one; it reads a clause and weighs it: an insult counts more with a target beside it, less
after a negation or within reported speech, and a threat counts only with a target. A
document's score is a logistic function of its matched clauses.

The insult lexicon (words and word beginnings, with weights) and the logistic function are
learned from labelled rows; a bounded number of them, drawn by hash, is used
(``max_rows``). Scores come from the text alone.

Defined cases: a null text is empty; an empty text has no clauses and gets the score of
clean text; label rows with nulls take no part; repeated rows are scored each; without
labels of both kinds the fixed lexicon and fixed coefficients hold; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.shared import settle, whole_text

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = range(6)

# Starting lexicon, in the languages of the documents; labels add to the insults.
_WORDS = {
    INSULT: "idiot moron stupid imbécile crétin idiota imbécil estúpido dummkopf trottel",
    THREAT: "kill hurt destroy burn tuer frapper brûler matar golpear quemar töten schlagen verbrennen",
    TARGET: "you your yours yourself u tu toi vous votre te ti usted ustedes tú du dich dir ihr euch",
    NEGATION: "not no never n't don't isn't ne pas jamais nunca jamás nicht nie kein keine",
    REPORT: "said says told claimed wrote quoted dit disait écrit dijo dice escribió sagte schrieb",
}
_CLAUSE_ENDS = ".!?;:,…"
_STRIPPED = string.punctuation + "¡¿«»“”„…–—"

PREFIXES = (7, 6, 5, 4)
LEXICON_TERMS = 4096
_CACHE_WORDS = 150_000
_BLOCK = 1000

# Coefficients where nothing can be learned: clean text about 0.1, one plain insult over 0.5.
_FIXED = ([-2.2, 1.4, 0.0, 0.3, 0.0], [0.0] * 5, [1.0] * 5)


@dataclass(frozen=True)
class Transducer:
    """Reads word classes; arcs scale the weight of the word read, ends that of the clause."""

    start: object
    arcs: dict[tuple[object, int], tuple[object, float]]
    ends: dict[object, float]

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same clause; their scales multiply."""
        start = (self.start, other.start)
        arcs, ends, open_states = {}, {}, [start]
        while open_states:
            state = open_states.pop()
            if state in ends:
                continue
            ends[state] = self.ends[state[0]] * other.ends[state[1]]
            for word in CLASSES:
                (a, x), (b, y) = self.arcs[state[0], word], other.arcs[state[1], word]
                arcs[state, word] = ((a, b), x * y)
                open_states.append((a, b))
        return Transducer(start, arcs, ends)

    def numbered(self) -> tuple[list[list[tuple[int, float]]], list[float]]:
        order = {s: i for i, s in enumerate([self.start, *(s for s in self.ends if s != self.start)])}
        table = [[(order[self.arcs[s, w][0]], self.arcs[s, w][1]) for w in CLASSES] for s in order]
        return table, [self.ends[s] for s in order]


def _machine(states: int, moves: dict[tuple[int, int], tuple[int, float]], ends: list[float]) -> Transducer:
    """States not named in ``moves`` stay as they are and scale by one."""
    arcs = {(s, w): moves.get((s, w), (s, 1.0)) for s, w in product(range(states), CLASSES)}
    return Transducer(0, arcs, dict(enumerate(ends)))


def grammar() -> Transducer:
    # A threat without a target in its clause weighs little.
    threat = _machine(4, {(0, THREAT): (1, 1.0), (0, TARGET): (2, 1.0), (1, TARGET): (3, 1.0), (2, THREAT): (3, 1.0)}, [1.0, 0.3, 1.0, 1.5])
    # An insult with a target in its clause weighs more.
    target = _machine(4, {(0, INSULT): (1, 1.0), (0, TARGET): (2, 1.0), (1, TARGET): (3, 1.0), (2, INSULT): (3, 1.0)}, [1.0, 1.0, 1.0, 1.3])
    # A negation reaches over the next two words.
    reach = {(s, NEGATION): (2, 1.0) for s in range(3)}
    for s in (1, 2):
        reach |= {(s, w): (s - 1, 0.7 if w in (INSULT, THREAT) else 1.0) for w in CLASSES if w != NEGATION}
    negation = _machine(3, reach, [1.0, 1.0, 1.0])
    # What is reported before the insult takes half of its weight.
    report = _machine(2, {(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.7), (1, THREAT): (1, 0.5)}, [1.0, 1.0])
    return threat.compose(target).compose(negation).compose(report)


@dataclass(frozen=True)
class Model:
    """Weights of insult terms (a term ending in * is a word beginning) and of the features."""

    terms: dict[str, float]
    coefficients: tuple[list[float], list[float], list[float]]

    def score(self, features: np.ndarray) -> np.ndarray:
        weights, mean, scale = map(np.asarray, self.coefficients)
        z = np.c_[np.ones(len(features)), (features - mean[1:]) / scale[1:]] @ weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Features of texts under a lexicon; words are looked up once per block."""

    FEATURES = 4

    def __init__(self, terms: dict[str, float]) -> None:
        self._table, self._ends = grammar().numbered()
        self._fixed = {w: c for c, words in _WORDS.items() for w in words.split()}
        self._terms = terms
        self._known: dict[str, tuple[int, float, bool]] = {}

    def _look_up(self, chunk: str) -> tuple[int, float, bool]:
        """(class, weight, whether a clause ends here)"""
        ends = chunk[-1:] in _CLAUSE_ENDS if chunk else False
        word = chunk.strip(_STRIPPED)
        if word in self._terms:
            return INSULT, self._terms[word], ends
        if word in self._fixed:
            kind = self._fixed[word]
            return kind, 2.0 if kind in (INSULT, THREAT) else 0.0, ends
        for n in PREFIXES:
            if len(word) > n and (weight := self._terms.get(word[:n] + "*")):
                return INSULT, weight, ends
        return OTHER, 0.0, ends

    def _clause(self, classes: list[int], weights: list[float]) -> float:
        state, total = 0, 0.0
        for kind, weight in zip(classes, weights, strict=True):
            state, scale = self._table[state][kind]
            total += scale * weight
        return total * self._ends[state]

    def features(self, texts: pa.Array) -> np.ndarray:
        """Total, density, strongest clause and share of matched clauses, by text."""
        out = np.zeros((len(texts), self.FEATURES))
        marked = pc.replace_substring(pc.utf8_lower(texts), "\n", " . ")
        split = pc.utf8_split_whitespace(marked)
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._known) > _CACHE_WORDS:
            self._known.clear()
        rows = []
        for chunk in distinct:
            row = self._known.get(chunk)
            if row is None:
                row = self._known[chunk] = self._look_up(chunk)
            rows.append(row)
        if not rows:
            return out
        kinds, weights, ends = (np.array(x) for x in zip(*rows, strict=True))
        codes = coded.indices.to_numpy()
        bounds = split.offsets.to_numpy()
        kind, weight, end = kinds[codes], weights[codes], ends[codes]
        starts_text = np.zeros(len(codes) + 1, bool)
        starts_text[bounds] = True
        opens = np.r_[True, end[:-1]] | starts_text[:-1]
        clause = np.cumsum(opens) - 1
        clause_at = np.flatnonzero(opens)
        clause_end = np.r_[clause_at[1:], len(codes)]
        text_of = np.searchsorted(bounds, clause_at, side="right") - 1
        matched = np.unique(clause[(kind == INSULT) | (kind == THREAT)])
        totals = np.zeros(len(clause_at))
        for c in matched.tolist():
            a, b = clause_at[c], clause_end[c]
            totals[c] = self._clause(kind[a:b].tolist(), weight[a:b].tolist())
        total = np.bincount(text_of, totals, len(texts))
        top = np.zeros(len(texts))
        np.maximum.at(top, text_of, totals)
        clauses = np.bincount(text_of, minlength=len(texts))
        hits = np.bincount(text_of, totals > 0, len(texts))
        words = np.diff(bounds)
        out[:, 0] = np.log1p(total)
        out[:, 1] = np.log1p(100 * total / (words + 20))
        out[:, 2] = top
        out[:, 3] = np.sqrt(hits / np.maximum(clauses, 1))
        return out


def _scored(docs: DataFrame, model: Model, keep_features: bool) -> DataFrame:
    """(doc_id, score) or (doc_id, f0, f1, ...)"""
    names = [f"f{i}" for i in range(Reader.FEATURES)] if keep_features else ["score"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.DoubleType()) for n in names]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.terms)
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                features = reader.features(pa.concat_arrays([part.column("text")]))
                columns = features.T if keep_features else [model.score(features)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(np.ascontiguousarray(c)) for c in columns]],
                    names=["doc_id", *names],
                )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(read, schema)


def _terms(labelled: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Words and word beginnings found in over five times the share of toxic texts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}']+"), F.lit(0)))

    def beginnings(n: int) -> Column:
        longer = F.filter("_words", lambda w: F.length(w) > n)
        return F.transform(longer, lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    terms = labelled.withColumn("_words", words).select(
        "toxic", F.explode(F.array_distinct(F.concat("_words", *map(beginnings, PREFIXES)))).alias("term")
    )
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    found = (
        terms.groupBy("term")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where(F.col("t") >= max(5, n_toxic // 200))
        .withColumn("weight", odds)
        .where(F.col("weight") >= float(np.log(5)))
        .orderBy(F.desc(F.col("t") * F.col("weight")), "term")
        .limit(LEXICON_TERMS)  # the size of the model
    )
    return {r["term"]: r["weight"] for r in found.collect()}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Logistic regression by Newton's method with a small ridge."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.0, *[1.0] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(
            (z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w
        )
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist(), [0.0, *mean.tolist()], [1.0, *scale.tolist()]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Model:
    """Lexicon and coefficients from about ``max_rows`` labelled rows outside the held-out fold.

    Rows are drawn by hash of their doc_id. Both halves of the draw are kept apart: one
    gives the lexicon, the other, on which the lexicon has not been fitted, the coefficients.
    """
    docs = docs.select("doc_id", "text")
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    share = min(1.0, max_rows / max(known.count(), 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    drawn = known.where(place < int(share * (1 << 20))).select(
        F.col("doc_id").alias("_labelled"),
        F.col("toxic").cast("int").alias("toxic"),
        (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(3)) < 2).alias("_lexicon"),
    )
    labelled = settle(
        docs.join(drawn, docs["doc_id"] == drawn["_labelled"]).select(
            docs["doc_id"], whole_text().alias("text"), "toxic", "_lexicon"
        )
    )
    sizes = {(r["_lexicon"], r["toxic"]): r["n"] for r in labelled.groupBy("_lexicon", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [sizes.get((part, label), 0) for part in (True, False) for label in (0, 1)]
    if min(counts) == 0:
        return Model({}, _FIXED)
    terms = _terms(labelled.where("_lexicon"), counts[1], counts[0])
    rest = labelled.where("NOT _lexicon")
    features = _scored(rest, Model(terms, _FIXED), True)
    label = rest.select(F.col("doc_id").alias("_id"), "toxic").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    rows = features.join(label, features["doc_id"] == label["_id"]).toPandas()  # about max_rows / 3
    x = rows[[f"f{i}" for i in range(Reader.FEATURES)]].to_numpy()
    return Model(terms, _logistic(x, rows["toxic"].to_numpy(dtype=float)))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 12_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = learn(docs, labels, max_rows)
    return _scored(docs, model, False).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 12_000) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    model = learn(docs, labels, max_rows)
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.terms)
        where = names.index("text")
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                texts = pc.fill_null(pa.concat_arrays([part.column(where)]), "")
                yield part.filter(pa.array(model.score(reader.features(texts)) < threshold))

    return docs.mapInArrow(clean, docs.schema)
