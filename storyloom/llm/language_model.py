"""A gated recurrent language model over words, scoring whole documents.

The output is class-factored: P(word) = P(class | state) * P(word | class). The most
frequent words are classes of their own; other words share classes by their endings, and
within those a word has its share of the counts of all training documents, one extra count
standing for all unknown words. A GRU over classes gives P(class | state). It is trained by
truncated backpropagation: tasks train on their documents from common weights, which are
averaged by their numbers of tokens, for several rounds on different documents. State is
carried from window to window, so a document is scored whole, however long.

Counts cover all training documents, and so do the gradient steps: the rounds read disjoint
parts of them that together are all.
The driver and the tasks hold the ``FREQUENT`` commonest words and the weights; counts of
all other words are joined.

Defined cases: a null text is empty and scores its end token alone; a null doc_id counts as
not held out; repeated rows are counted and scored each; without training rows all words
are unknown; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.shared import settle, whole_text

END = ""  # no word is empty

CLASSES = 128
SINGLES = 64  # words with classes of their own, after the end token's class 0
SHARED = CLASSES - SINGLES - 1
STATE = 32
FREQUENT = 1 << 18

ROUNDS = 3
LANES, WINDOW = 256, 32
LEARNING_RATE = 0.01
TOKENS_A_TASK = 1_000_000

# Rows of the output layer worked on at a time, so that they stay in the cache.
OUTPUT_ROWS = 2048
_ROWS = np.ones(OUTPUT_ROWS, np.float32)

SCORE_LANES, SCORE_WINDOW = 512, 64
BLOCK = 2000


def held_out() -> Column:
    rest = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7
    return F.coalesce(rest == 2, F.lit(False))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, bounds, distinct words): word codes of all texts, and each text's slice."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.values
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False).astype(bool)
    before = np.r_[0, np.cumsum(real)]
    coded = words.filter(pa.array(real)).dictionary_encode()
    return coded.indices.to_numpy(), before[lists.offsets.to_numpy()], coded.dictionary


def _strings(batch: pa.RecordBatch, at: int) -> pa.Array:
    return pa.concat_arrays([batch.column("text").slice(at, BLOCK)])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): counts over ``docs``, the end token among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _, words = split_words(pa.concat_arrays([batch.column("text")]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([words, pa.array([END])]),
                    pa.array(np.r_[np.bincount(codes, minlength=len(words)), batch.num_rows]),
                ],
                names=["word", "c"],
            )

    found = docs.select(whole_text().alias("text")).mapInArrow(count, "word string, c long")
    return found.where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """The commonest words with their counts, class totals, and the totals N and V."""

    words: pa.Array
    counts: np.ndarray
    singles: dict[str, int]
    log_class: np.ndarray  # log10 of N_k + V_k + 1, by class; zero for single words
    tokens: int
    types: int
    ends: int

    def classes(self, words: pa.Array) -> np.ndarray:
        """The class of each word, worked out once for each ending."""
        coded = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
        endings = [_ending_class(x) for x in coded.dictionary.to_pylist()]
        found = np.array(endings, np.uint8)[coded.indices.to_numpy()]
        names = pa.array(list(self.singles), pa.string())
        single = pc.fill_null(pc.index_in(words, names), -1).to_numpy()
        return np.where(single >= 0, np.array(list(self.singles.values()), np.uint8)[single], found)


def _ending_class(ending: str) -> int:
    return SINGLES + 1 + zlib.crc32(ending.encode("utf-8", "replace")) % SHARED


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("v"),
        F.sum(F.when(F.col("word") == END, F.col("c"))).alias("e"),
    ).first()
    # Sixteen bins for every doubling of a count: enough words of the top bins, and no more.
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect()
    least, room = None, FREQUENT
    for r in sorted(levels, key=lambda r: -r["level"]):
        room -= r["v"]
        if room < 0:
            break
        least = r["level"]
    top = counts.where(F.lit(False) if least is None else level >= least)
    top = top.where(F.col("word") != END).toArrow()  # FREQUENT rows at most
    top = top.sort_by([("c", "descending"), ("word", "ascending")])
    words = pa.concat_arrays(top.column("word").chunks or [pa.array([], pa.string())])
    singles = {w: i + 1 for i, w in enumerate(words[:SINGLES].to_pylist())} | {END: 0}
    ending = F.crc32(F.encode(F.substring("word", -2, 2), "UTF-8")) % SHARED + SINGLES + 1
    sums = (
        counts.where(~F.col("word").isin(list(singles)))
        .groupBy(ending.cast("int").alias("k"))
        .agg((F.sum("c") + F.count(F.lit(1)) + 1).alias("n"))
        .collect()
    )
    log_class = np.zeros(CLASSES)
    for r in sums:
        log_class[r["k"]] = np.log10(r["n"])
    return Vocabulary(
        words.cast(pa.string()),
        top.column("c").to_numpy().astype(np.int64),
        singles,
        log_class,
        total["n"] or 0,
        total["v"],
        total["e"] or 0,
    )


def _sigmoid(x: np.ndarray, safe: bool) -> np.ndarray:
    """In place; beyond 80 it is zero or one in these floats anyway."""
    if not safe:
        np.clip(x, -80, 80, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """GRU weights: input rows by class, recurrence, and output to classes."""

    SHAPES = {
        "x": (CLASSES, 3 * STATE),
        "u": (STATE, 3 * STATE),
        "o": (STATE, CLASSES),
        "b": (CLASSES,),
    }

    def __init__(self, flat: np.ndarray) -> None:
        self.parts, at = {}, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            self.parts[name] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n
        self.safe = self.bounded()

    @classmethod
    def start(cls, class_counts: np.ndarray) -> np.ndarray:
        """Small weights; the output begins as the classes' shares."""
        draw = np.random.default_rng(7)
        flat = [draw.normal(0, 0.1, int(np.prod(s))) for n, s in cls.SHAPES.items() if n != "b"]
        return np.concatenate([*flat, np.log((class_counts + 1) / (class_counts + 1).sum())])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parts[n].ravel() for n in self.SHAPES]).astype(float)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from input rows ``x``: (new state, update gate, reset gate, candidate)."""
        u = self.parts["u"]
        gates = h @ u[:, : 2 * STATE]
        gates += x[:, : 2 * STATE]
        gates = _sigmoid(gates, self.safe)
        z, r = gates[:, :STATE], gates[:, STATE:]
        c = (r * h) @ u[:, 2 * STATE :]
        c += x[:, 2 * STATE :]
        c *= 2
        c = _sigmoid(c, self.safe)
        c *= 2
        c -= 1
        new = c - h
        new *= z
        new += h
        return new, z, r, c

    def bounded(self) -> bool:
        """Whether no exponent can leave the range of these floats: states lie within one."""
        p = self.parts
        out = np.abs(p["b"]) + np.abs(p["o"]).sum(axis=0)
        gates = np.abs(p["x"]).max(axis=0) + np.abs(p["u"]).sum(axis=0)
        return max(float(out.max()), float(gates.max()) * 2) < 60

    def _outputs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponents of the classes without their bias, and the exponents of the bias.

        Where they could be too large, the largest logit of a row is taken off first.
        """
        p = self.parts
        logits = states @ p["o"]
        if self.safe:
            return logits, np.exp(p["b"])
        logits += p["b"]
        logits -= logits.max(axis=1, keepdims=True)
        return logits, np.ones_like(p["b"])

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        found = np.empty(len(targets), states.dtype)
        for at in range(0, len(targets), OUTPUT_ROWS):
            part = slice(at, at + OUTPUT_ROWS)
            logits, shares = self._outputs(states[part])
            chosen = logits[np.arange(len(logits)), targets[part]]
            np.exp(logits, out=logits)
            found[part] = chosen + np.log(shares)[targets[part]] - np.log(logits @ shares)
        return found

    def output_gradients(
        self, states: np.ndarray, targets: np.ndarray, counted: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the output weights and bias, and of the states.

        ``counted`` has the weight of each token: one over their number, or zero.
        """
        p = self.parts
        d_o, d_b, d_states = np.zeros_like(p["o"]), np.zeros_like(p["b"]), np.empty_like(states)
        for at in range(0, len(targets), OUTPUT_ROWS):
            part = slice(at, at + OUTPUT_ROWS)
            # Differences of probabilities, still to be multiplied by the classes' shares.
            d, shares = self._outputs(states[part])
            np.exp(d, out=d)
            d *= (counted[part] / (d @ shares))[:, None]
            goal = targets[part]
            d[np.arange(len(d)), goal] -= counted[part] / shares[goal]
            d_o += (states[part].T @ d) * shares
            d_b += (_ROWS[: len(d)] @ d) * shares
            np.matmul(d, (p["o"] * shares).T, out=d_states[part])
        return d_o, d_b, d_states

    def gradients(
        self,
        inputs: np.ndarray,
        keep: np.ndarray,
        targets: np.ndarray,
        counted: np.ndarray,
        h: np.ndarray,
    ) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients over a window (steps, lanes), and the state it ends in."""
        p = self.parts
        steps = len(inputs)
        saved, states = [], []
        for t in range(steps):
            h = h * keep[t][:, None]
            new, z, r, c = self.step(p["x"][inputs[t]], h)
            saved.append((h, z, r, c))
            states.append(new)
            h = new
        d_o, d_b, from_output = self.output_gradients(
            np.concatenate(states), targets.ravel(), counted.ravel()
        )
        from_output = from_output.reshape(steps, -1, STATE)
        out = {"o": d_o, "b": d_b}
        lanes = h.shape[0]
        d_x = np.empty((steps, lanes, 3 * STATE), np.float32)
        u_gates = np.ascontiguousarray(p["u"][:, : 2 * STATE].T)
        u_new = np.ascontiguousarray(p["u"][:, 2 * STATE :].T)
        d_h = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            before, z, r, c = saved[t]
            d_h += from_output[t]
            into = d_x[t]
            kept = d_h * z
            np.multiply(kept, 1 - c * c, out=into[:, 2 * STATE :])
            np.multiply(d_h * (c - before), z * (1 - z), out=into[:, :STATE])
            back = into[:, 2 * STATE :] @ u_new
            np.multiply(back * before, r * (1 - r), out=into[:, STATE : 2 * STATE])
            d_h -= kept
            back *= r
            d_h += back
            d_h += into[:, : 2 * STATE] @ u_gates
            d_h *= keep[t][:, None]
        # One product a window for each part of the recurrence.
        flat_x = d_x.reshape(-1, 3 * STATE)
        before = np.concatenate([x[0] for x in saved])
        reset = np.concatenate([x[2] for x in saved])
        reset *= before
        d_u = np.concatenate([before.T @ flat_x[:, : 2 * STATE], reset.T @ flat_x[:, 2 * STATE :]], axis=1)
        # Sums by input class: rows of one class together, each run added up at once.
        flat = inputs.ravel()
        order = np.argsort(flat, kind="stable")
        kinds, first = np.unique(flat[order], return_index=True)
        rows = np.zeros_like(p["x"])
        rows[kinds] = np.add.reduceat(flat_x[order], first)
        return out | {"u": d_u, "x": rows}, h


class Adam:
    def __init__(self, network: Network) -> None:
        self.network, self.t = network, 0
        self.m = {n: np.zeros_like(w) for n, w in network.parts.items()}
        self.v = {n: np.zeros_like(w) for n, w in network.parts.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        for name, g in gradients.items():
            g = g * clip
            self.m[name] += 0.1 * (g - self.m[name])
            self.v[name] += 0.01 * (g * g - self.v[name])
            m = self.m[name] / (1 - 0.9**self.t)
            v = self.v[name] / (1 - 0.99**self.t)
            self.network.parts[name] -= LEARNING_RATE * m / (np.sqrt(v) + 1e-8)
        self.network.safe = self.network.bounded()


def train_lanes(network: Network, sequence: np.ndarray) -> None:
    """Steps over documents laid end to end; every class 0 ends one.

    The sequence is cut into lanes of one length; what the last one lacks counts nothing.
    """
    if not len(sequence):
        return
    lanes = min(LANES, max(1, len(sequence) // (2 * WINDOW)))
    n = -(-len(sequence) // lanes)
    padded = np.zeros(lanes * n, np.uint8)
    padded[: len(sequence)] = sequence
    real = (np.arange(lanes * n) < len(sequence)).reshape(lanes, n).T
    target = padded.reshape(lanes, n).T
    source = np.zeros_like(target)
    source[1:] = target[:-1]
    source[0, 1:] = target[-1, :-1]  # a lane goes on from the one before, but for its state
    keep = (source != 0).astype(np.float32)  # a new document starts from an empty state
    h = np.zeros((lanes, STATE), np.float32)
    adam = Adam(network)
    for at in range(0, n, WINDOW):
        part = slice(at, at + WINDOW)
        counted = real[part].astype(np.float32)
        counted /= max(1.0, float(counted.sum()))
        gradients, h = network.gradients(source[part], keep[part], target[part], counted, h)
        adam.step(gradients)


def training_sequences(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(round, n, sequence): class numbers of the training documents, each ended by 0."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(ROUNDS))
    chosen = (
        docs.where(~held_out())
        .select("doc_id", whole_text().alias("text"))
        .select("text", draw.cast("int").alias("round"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds, words = split_words(pa.concat_arrays([batch.column("text")]))
            classes = shared.value.classes(words)[codes]
            sequences = [
                classes[a:b].tobytes() + b"\0" for a, b in zip(bounds, bounds[1:], strict=False)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("round"),
                    pa.array([len(s) for s in sequences], pa.int64()),
                    pa.array(sequences, pa.binary()),
                ],
                names=["round", "n", "sequence"],
            )

    return chosen.mapInArrow(read, "round int, n long, sequence binary")


def train(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights after all rounds, flat."""
    spark = docs.sparkSession
    sequences = settle(training_sequences(docs, vocabulary))
    counts = np.zeros(CLASSES)
    # Class shares follow from the word counts: no pass over texts.
    np.add.at(counts, vocabulary.classes(vocabulary.words), vocabulary.counts)
    counts[0] = vocabulary.ends
    weights = Network.start(counts)
    sizes = {
        r["round"]: r["n"]
        for r in sequences.groupBy("round").agg(F.sum("n").alias("n")).collect()
    }
    for number in range(ROUNDS):
        if not sizes.get(number):
            continue
        shared = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            network = Network(shared.value)
            # A byte a token, about TOKENS_A_TASK of them: the steps don't depend on batches.
            found = [x for batch in batches for x in batch.column("sequence").to_pylist()]
            sequence = np.frombuffer(b"".join(found), np.uint8)
            train_lanes(network, sequence)
            seen = len(sequence)
            if seen:
                flat = network.flat()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(flat), dtype=np.int32)),
                        pa.array(flat * seen),
                        pa.array(np.full(len(flat), float(seen))),
                    ],
                    names=["i", "w", "n"],
                )

        tasks = -(-sizes[number] // TOKENS_A_TASK)
        mean = (
            sequences.where(F.col("round") == number)
            .select("sequence")
            .repartition(tasks)
            .mapInArrow(learn, "i int, w double, n double")
            .groupBy("i")
            .agg((F.sum("w") / F.sum("n")).alias("w"))
            .collect()  # one row a weight
        )
        weights = np.zeros(len(weights))
        for r in mean:
            weights[r["i"]] = r["w"]
    return weights


def class_scores(network: Network, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 P(class | what came before) of every token; bounds part the documents.

    Documents lie end to end in lanes, longest lane first, so all of a document is read in
    order with its state carried along; lanes that have ended leave the batch.
    """
    sizes = np.diff(bounds)
    lanes = [[] for _ in range(min(SCORE_LANES, len(sizes)))]
    length = np.zeros(len(lanes), np.int64)
    for doc in np.argsort(-sizes, kind="stable").tolist():
        lane = int(length.argmin())
        lanes[lane].append(doc)
        length[lane] += sizes[doc]
    order = np.argsort(-length, kind="stable")
    places = [
        np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in lanes[i]]) for i in order
    ]
    length = length[order]
    starts = np.zeros(len(classes) + 1, bool)
    starts[bounds] = True
    out = np.empty(len(classes))
    previous = np.r_[0, classes[:-1]]
    h = np.zeros((len(places), STATE), np.float32)
    x = network.parts["x"]
    for at in range(0, int(length[0]), SCORE_WINDOW):
        active = int((length > at).sum())
        # (steps, lanes) of this window; lanes are in order of length, so gaps end a row.
        window = np.full((min(SCORE_WINDOW, int(length[0]) - at), active), -1, np.int64)
        for lane in range(active):
            part = places[lane][at : at + SCORE_WINDOW]
            window[: len(part), lane] = part
        begin = starts[window]
        source = np.where(begin, 0, previous[window])
        width = (window >= 0).sum(axis=1).tolist()
        states = []
        for t, active in enumerate(width):
            h = h[:active] * ~begin[t, :active, None]
            h = network.step(x[source[t, :active]], h)[0]
            states.append(h)
        here = np.concatenate([window[t, :w] for t, w in enumerate(width)])
        out[here] = network.log_probabilities(np.concatenate(states), classes[here])
    return out / np.log(10)


def _score_parts(docs: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    """Sums over the frequent words and classes of each document, and its other words."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")],
            *[T.StructField(n, T.DoubleType()) for n in ("plain", "shared", "model")],
            T.StructField("others", T.ArrayType(T.StringType())),
        ]
    )
    trained = vocabulary.tokens > 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        network = Network(weights)
        known_words = vocabulary.words
        log_counts = np.log10(vocabulary.counts + 1)
        end_log = np.log10(vocabulary.ends + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                texts = _strings(batch, at)
                codes, bounds, words = split_words(texts)
                place = pc.fill_null(pc.index_in(words, known_words), -1).to_numpy()
                kinds = vocabulary.classes(words)
                sizes = np.diff(bounds)
                n_docs = len(sizes)
                doc_of = np.repeat(np.arange(n_docs), sizes)
                token_place = place[codes]
                frequent = token_place >= 0
                logs = np.where(frequent, np.r_[log_counts, 0.0][token_place], 0.0)
                token_kind = kinds[codes]
                in_class = token_kind > SINGLES
                # Every document's classes, its end after them.
                full = np.zeros(len(codes) + n_docs, np.uint8)
                full[np.arange(len(codes)) + doc_of] = token_kind
                full_bounds = bounds + np.arange(n_docs + 1)
                by_class = class_scores(network, full, full_bounds)
                by_doc = np.add.reduceat(by_class, full_bounds[:-1])

                def total(values: np.ndarray, doc_of=doc_of, n_docs=n_docs) -> np.ndarray:
                    return np.bincount(doc_of, values, n_docs)

                rest = np.flatnonzero(~frequent)
                ends = np.searchsorted(rest, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, BLOCK),
                        pa.array(sizes.astype(np.int64) + 1),
                        pa.array(total(frequent).astype(np.int64) + int(trained)),
                        pa.array(total(logs) + end_log),
                        pa.array(total(np.where(in_class, logs - vocabulary.log_class[token_kind], 0.0))),
                        pa.array(by_doc),
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()), words.take(pa.array(codes[rest]))
                        ),
                    ],
                    names=[f.name for f in schema],
                )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(score, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents, by a model of those that are not held out."""
    counts = settle(count_words(docs.where(~held_out())))
    vocabulary = read_vocabulary(counts)
    weights = train(docs, vocabulary)
    parts = settle(
        _score_parts(docs, vocabulary, weights).withColumn("row", F.monotonically_increasing_id())
    )
    # Words beyond the commonest get their counts by a join.
    others = (
        parts.select("row", F.explode("others").alias("word"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("other_logs"),
            F.count("c").alias("other_known"),
        )
    )
    other_logs = F.coalesce("other_logs", F.lit(0.0))
    log_total = float(np.log10(vocabulary.tokens + vocabulary.types + 1))
    return parts.join(others, "row", "left").select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("other_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("plain") + other_logs - F.col("n_tokens") * F.lit(log_total)).alias("base_score"),
        (F.col("model") + F.col("shared") + other_logs).alias("score"),
    )
