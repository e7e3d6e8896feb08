"""Log-bilinear language model, trained with noise-contrastive estimation, over words.

Every word belongs to a class: the most frequent words are classes of their own, other words share
the class of their last two bytes. The model predicts a class from the two classes before it,

    score(w | v, u) = a[v] . q[w] + b[u] . r[w] + bias[w],

a log-bilinear form whose normaliser over all classes is a product of two matrices of exponentials,
so that normalised probabilities of all class triples come from batched matrix products. Both contexts
are trained in one objective: after a start from the counts of neighbouring classes, tasks take
noise-contrastive steps over the tokens of their own texts, and their models are averaged by tokens, in a
few rounds over all training texts. Inside a class a word has its share of the class's training tokens, less what the class leaves to words that
training never saw: as in the unigram base, all of those with one ending are one event. All counts
come from all training texts.

Words of the corpus are counted by a shuffle. A bounded number of the most frequent words goes to
every task; the others are looked up by a join of (row, word), whose keys are rare by construction.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.plans.pca import merge_arrays

from .common import with_row_key, write_shared

#: words that are classes of their own, and classes by last two bytes
SHORTLIST, ENDINGS = 448, 256
#: the end of a text, the start of a text, and words of no listed ending
END, START, REST = SHORTLIST + ENDINGS, SHORTLIST + ENDINGS + 1, SHORTLIST + ENDINGS + 2
CLASSES = SHORTLIST + ENDINGS + 3
#: words whose counts every task holds, at most
HEAD = 1 << 17
#: words that a counting task holds before it hands their counts on
HELD_WORDS = 1 << 19
DIM = 24
#: noise samples per token in the objective; their expectation is taken exactly
NOISE = 20.0
STEPS = 150
#: rounds of the joint training over all texts, a task's passes in one, contexts of a step, steps of a task at least
ROUNDS, PASSES, STEP_CONTEXTS, LEAST_STEPS = 2, 1, 2048, 100
JOINT_RATE = 0.004
#: tokens of a task of the joint training at least, where there are so many, and tokens that it holds at once
TASK_TOKENS, HELD_TOKENS = 1 << 21, 1 << 22
LOG10 = math.log(10)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; they end at ASCII white space."""
    return (text or b"").lower().split()


# --- the log-bilinear model -----------------------------------------------------------------------


def train_nce(pairs: np.ndarray, noise: np.ndarray, dim: int = DIM, steps: int = STEPS, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and target vectors and target biases from counts (context, target), by noise-contrastive
    estimation: data pairs against NOISE draws from ``noise`` for each. The sum over draws is taken as
    its expectation, so every pair of the table is used in each step. Adam, fixed seed."""
    n = len(noise)
    rng = np.random.default_rng(seed)
    total = max(1.0, pairs.sum())
    data = (pairs / total).astype(np.float32)
    weight = (pairs.sum(axis=1, keepdims=True) / total * NOISE).astype(np.float32) * noise.astype(np.float32)
    log_kn = np.log(NOISE * noise).astype(np.float32)
    p = [(rng.standard_normal((n, dim)) * 0.1).astype(np.float32), (rng.standard_normal((n, dim)) * 0.1).astype(np.float32), np.log(noise).astype(np.float32)]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in p]
    for step in range(1, steps + 1):
        odds = p[0] @ p[1].T + p[2] - log_kn
        is_data = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        grad = weight * is_data - data * (1 - is_data)
        grads = [grad @ p[1], grad.T @ p[0], grad.sum(axis=0)]
        rate = 0.08 * (1 - 0.9 * step / steps)
        for x, (m, v), g in zip(p, moments, grads):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-9)
    return p[0], p[1], p[2]


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, dim) sums of ``values`` by row number."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[own[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def joint_loss(p: list[np.ndarray], u: np.ndarray, v: np.ndarray, data: np.ndarray, noise: np.ndarray) -> float:
    """Noise-contrastive loss of counts ``data`` (contexts, classes) of classes after v after u, against NOISE draws for
    each. ``p``: near and far contexts a and b, their targets q and r, bias."""
    a, b, q, r, bias = p
    odds = a[v] @ q.T + b[u] @ r.T + bias - np.log(NOISE * noise)
    expected = data.sum(axis=1, keepdims=True) * NOISE * noise
    return float((data * np.logaddexp(0, -odds) + expected * np.logaddexp(0, odds)).sum())


def joint_gradients(p: list[np.ndarray], u: np.ndarray, v: np.ndarray, data: np.ndarray, noise: np.ndarray) -> list[np.ndarray]:
    """Gradients of ``joint_loss``; the sum over draws is taken as its expectation."""
    a, b, q, r, bias = p
    near, far = a[v], b[u]
    odds = np.concatenate([near, far], axis=1) @ np.concatenate([q, r], axis=1).T + (bias - np.log(NOISE * noise))
    is_data = np.exp(np.negative(np.clip(odds, -30, 30, out=odds), out=odds), out=odds)
    is_data = np.divide(1, np.add(is_data, 1, out=is_data), out=is_data)
    # data and expected noise share a factor: (data + expected) * is_data - data
    grad = data.sum(axis=1, keepdims=True) * (NOISE * noise)
    grad = (grad + data) * is_data - data
    return [_scatter(v, grad @ q, len(bias)), _scatter(u, grad @ r, len(bias)), grad.T @ near, grad.T @ far, grad.sum(axis=0)]


class JointTrainer:
    """Adam on the joint objective, over tokens as they come. Tokens are counted by their two contexts, so that a step
    takes many tokens at once and all classes as noise."""

    def __init__(self, p: list[np.ndarray], noise: np.ndarray, seed: int, rate: float):
        self.p, self.rng, self.rate, self.steps, self.tokens = [x.copy() for x in p], np.random.default_rng(seed), rate, 0, 0
        self._moments = [(np.zeros_like(x), np.zeros_like(x)) for x in p]
        self._noise = noise.astype(np.float32)

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """PASSES over tokens, or as many as the least number of steps takes."""
        n = len(self._noise)
        cells, times = np.unique((u * n + v) * n + w, return_counts=True)
        context = cells // n
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        ends = np.append(first[1:], len(cells))
        u, v, w = context[first] // n, context[first] % n, cells % n
        cuts = -(-len(first) // STEP_CONTEXTS)
        passes = max(PASSES, -(-(LEAST_STEPS - self.steps) // cuts))
        for k in range(passes):
            for number, at in enumerate(np.array_split(self.rng.permutation(len(first)), cuts)):
                sizes = ends[at] - first[at]
                inner = np.arange(sizes.sum()) + np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes)
                data = np.zeros((len(at), n), np.float32)
                data[np.repeat(np.arange(len(at)), sizes), w[inner]] = times[inner]
                grads = joint_gradients(self.p, u[at], v[at], data / data.sum(), self._noise)
                self.steps += 1
                rate = self.rate * (1 - 0.9 * (k * cuts + number) / (passes * cuts))
                for x, (m, s), g in zip(self.p, self._moments, grads):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    x -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)
        self.tokens += int(times.sum())


def train_jointly(tokens: DataFrame, p: list[np.ndarray], noise: np.ndarray, count: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Rounds over all texts of ``tokens`` (ids binary, as ``class_ids`` has them; ``count`` tokens): every task trains from the
    same start on its own texts, and the results are averaged, each weighing its tokens, by a tree of tasks. Small
    partitions share a task, as a task takes a least number of steps."""
    spark = tokens.sparkSession
    tasks = max(1, min(tokens.rdd.getNumPartitions(), -(-count // TASK_TOKENS)))
    tokens = tokens.coalesce(tasks)
    shapes = [x.shape for x in p]
    sizes = [x.size for x in p]
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((p, noise))  # of fixed size

        def train(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer, held, n = None, [], 0

            def learn() -> None:
                nonlocal trainer, n
                if trainer is None:  # what a task draws follows from its first text, so that a rerun draws alike
                    trainer = JointTrainer(*shared.value, seed=zlib.crc32(held[0].tobytes()) + turn, rate=JOINT_RATE / (1 + turn))
                trainer.learn(*(np.concatenate([x[i : len(x) - 2 + i] for x in held]).astype(np.int64) for i in range(3)))
                held.clear()
                n = 0

            for batch in batches:
                for x in batch.column(0):
                    held.append(np.frombuffer(x.as_buffer(), np.int16))
                    n += len(held[-1]) - 2
                    if n >= HELD_TOKENS:
                        learn()
            if held:
                learn()
            total = np.zeros(1 + sum(sizes))
            if trainer is not None:
                total[0] = trainer.tokens
                total[1:] = np.concatenate([x.ravel() for x in trainer.p]) * float(trainer.tokens)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = merge_arrays(tokens.mapInArrow(train, "part binary"), tasks, (1 + sum(sizes),), 16)
        total = sum((np.frombuffer(bytes(r[0])) for r in parts.toLocalIterator()), np.zeros(1 + sum(sizes)))
        if total[0]:
            flat = (total[1:] / total[0]).astype(np.float32)
            p = [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]
    return p


@dataclass
class ClassModel:
    """Context and target vectors of the nearer and the farther class before, and biases."""

    near: tuple[np.ndarray, np.ndarray]
    far: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, normaliser): log10 scores of (context, class) and the log10 normaliser of each
        pair of contexts, by matrix products. START is no target."""
        a = (self.near[0] @ self.near[1].T + self.bias).astype(np.float64)
        b = (self.far[0] @ self.far[1].T).astype(np.float64)
        a[:, START] = -np.inf
        top_a, top_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        z = np.log(np.exp(a - top_a) @ np.exp(b - top_b).T) + top_a + top_b.T
        return ((a / LOG10).astype(np.float32), (b / LOG10).astype(np.float32), (z / LOG10).astype(np.float32))


# --- words, classes and counts that every task holds ----------------------------------------------


@dataclass
class Lexicon:
    """The HEAD words with their training counts, and the classes."""

    words: list[bytes]
    counts: np.ndarray
    endings: list[bytes]

    def classes(self) -> tuple[dict[bytes, int], dict[bytes, int]]:
        """Class of a head word; class of an ending."""
        by_ending = {e: SHORTLIST + i for i, e in enumerate(self.endings)}
        of = {w: i if i < SHORTLIST else by_ending.get(w[-2:], REST) for i, w in enumerate(self.words)}
        return of, by_ending


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all rows of ``texts`` (one binary column). Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(vocabulary: DataFrame) -> list[tuple[bytes, int]]:
    """The SHORTLIST most frequent words with their counts, and behind them others that are frequent, HEAD at most, the
    most frequent first. A histogram of the counts' logarithms tells where to cut, so that only the words taken leave
    the executors. What a word scores doesn't depend on whether it is among the others."""
    top = vocabulary.orderBy(F.desc("n"), "word").limit(SHORTLIST).toArrow()
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    found = dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))
    least, taken = None, 0
    for r in sizes:  # a thousand levels at most
        taken += r["words"]
        if taken > HEAD - SHORTLIST:
            break
        least = r["least"]
    if least is not None:
        rows = vocabulary.filter(F.col("n") >= least).toArrow()
        found |= dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist()))
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def class_ids(texts: DataFrame, lexicon) -> DataFrame:
    """(ids binary) for each text: 16-bit class numbers, two STARTs before and END behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, endings = lexicon.value.classes()
        get = of.get
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for text in batch.column(0).slice(lo, 256):
                    ids = [c if (c := get(w)) is not None else endings.get(w[-2:], REST) for w in words_of(text.as_py())]
                    out.append(np.array([START, START, *ids, END], np.int16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return texts.mapInArrow(run, "ids binary")


def _class_pairs(tokens: DataFrame) -> DataFrame:
    """(kind, cell, n), cell = context * CLASSES + class: counts of classes after the class before (kind 0) and after the one
    before that (kind 1). A task sends at most
    2 * CLASSES**2 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CLASSES * CLASSES), np.int64)
        held, size = [], 0

        def count() -> None:
            nonlocal size
            for kind in (0, 1):
                cells = [x[1 - kind : len(x) - 1 - kind] * CLASSES + x[2:] for x in held]
                total[kind] += np.bincount(np.concatenate(cells), minlength=total.shape[1]) if cells else 0
            held.clear()
            size = 0

        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_buffer(), np.int16).astype(np.int64))
                size += len(held[-1])
                if size >= 1 << 18:
                    count()
        count()
        for kind in (0, 1):
            at = np.flatnonzero(total[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[kind][at])], names=["kind", "cell", "n"])

    return tokens.mapInArrow(run, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))


@dataclass
class ScoringModel:
    lexicon: Lexicon
    classes: ClassModel
    #: tokens of each class, and the share it leaves to unseen words
    class_tokens: np.ndarray
    unseen: np.ndarray
    tokens: int
    distinct: int
    texts: int


def fit(train: DataFrame) -> tuple[ScoringModel, DataFrame]:
    """The model and the table (word, n) from all rows of ``train`` (one column, the text)."""
    spark = train.sparkSession
    texts = train.select(F.col(train.columns[0]).cast("binary").alias("text"))
    vocabulary = write_shared(word_counts(texts), "vocabulary")
    n_texts = texts.count()
    n_words, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = head_words(vocabulary)
    words = [w for w, _ in head]
    tail = vocabulary.withColumn("ending", F.expr("CASE WHEN octet_length(word) > 2 THEN substring(word, octet_length(word) - 1, 2) ELSE word END"))
    by_ending = {bytes(r[0]): (r[1], r[2], r[3]) for r in tail.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long"))).collect()}  # two bytes: 66,000 endings at most
    for w, times in head[:SHORTLIST]:  # words that are classes of their own leave their ending's class
        if w[-2:] in by_ending:
            n, k, once = by_ending[w[-2:]]
            by_ending[w[-2:]] = (n - times, k - 1, once - (times == 1))
    endings = sorted((e for e in by_ending if by_ending[e][0] > 0), key=lambda e: (-by_ending[e][0], e))[:ENDINGS]
    lexicon = Lexicon(words, np.array([n for _, n in head], np.int64), endings)
    shared = spark.sparkContext.broadcast(lexicon)
    pairs = np.zeros((2, CLASSES * CLASSES))
    tokens = write_shared(class_ids(texts, shared), "classes")
    counted = write_shared(_class_pairs(tokens), "pairs")
    for kind in (0, 1):
        rows = counted.filter(F.col("kind") == kind).select("cell", "n").toArrow()  # CLASSES**2 rows at most
        pairs[kind, rows["cell"].to_numpy()] = rows["n"].to_numpy()
    pairs = pairs.reshape(2, CLASSES, CLASSES)
    class_tokens = pairs[0].sum(axis=0)
    noise = (class_tokens + 0.5) / (class_tokens.sum() + 0.5 * CLASSES)
    near = train_nce(pairs[0], noise)
    far = train_nce(pairs[1], noise, seed=2)
    # a start from which both are trained together: the farther context says half of what it says alone
    a, b, q, r, bias = train_jointly(tokens, [near[0], far[0] * np.float32(0.5), near[1], far[1], near[2]], noise, int(class_tokens.sum()))
    model = ClassModel((a, q), (b, r), bias)
    unseen = np.full(CLASSES, 1e-12)
    seen_once = {e: by_ending[e] for e in endings}
    for i, e in enumerate(endings):
        n, _, single = seen_once[e]
        unseen[SHORTLIST + i] = (single + 0.5) / (n + 1.0)
    rest = [by_ending[e] for e in by_ending if e not in seen_once]
    unseen[REST] = (sum(x[2] for x in rest) + 0.5) / (max(sum(x[0] for x in rest), class_tokens[REST]) + 1.0)
    return ScoringModel(lexicon, model, class_tokens, np.minimum(unseen, 0.999), int(n_words) + n_texts, int(distinct) + (n_texts > 0), n_texts), vocabulary


def score_texts(docs: DataFrame, model: ScoringModel, vocabulary: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, then n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is one token, its end. Repeated rows come out repeated; an empty table
    gives an empty table; columns not in ``keep`` take no part. Sums of logarithms may differ in
    their last digits from run to run.
    """
    spark = docs.sparkSession
    keep = keep or []
    shared = spark.sparkContext.broadcast(model)  # HEAD words and tables of fixed size
    aside = [f"_{i}" for i in range(len(keep))]
    rows = with_row_key(docs.select(F.col(text_col).cast("binary").alias("_text"), *[F.col(c).alias(x) for c, x in zip(keep, aside)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ScoringModel = shared.value
        near, far, norm = m.classes.tables()
        of, endings = m.lexicon.classes()
        position = {w: i for i, w in enumerate(m.lexicon.words)}
        log_counts = np.log10(m.lexicon.counts.astype(np.float64))
        log_base = np.log10(m.lexicon.counts + 1.0)
        head_class = np.array([of[w] for w in m.lexicon.words], np.int64)
        log_seen = np.log10(1 - m.unseen) - np.log10(np.maximum(m.class_tokens, 1))
        log_unseen = np.log10(m.unseen)
        head_inside = log_counts + log_seen[head_class]
        head_inside[:SHORTLIST] = 0.0  # a class of one word
        base_norm = math.log10(m.tokens + m.distinct + 1)
        end_base = math.log10(m.texts + 1)
        get, n_head = position.get, len(position)
        # tail rows: a word's part of the base score is log10(c + 1), of the score log10(c) + known if
        # it has a count and unknown otherwise
        names = ["_row", "word", "tf", "known", "unknown", "n_tokens", "n_known", "base_score", "score"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_pylist()
            for lo in range(0, batch.num_rows, 512):
                out_rows: list[tuple] = []
                tails: list[tuple[int, bytes, int, int]] = []
                for key, text in zip(keys[lo : lo + 512], batch.column(0).slice(lo, 512)):
                    words = words_of(text.as_py())
                    ids = np.array([get(w, n_head) for w in words], np.int64)
                    in_head = ids < n_head
                    at = ids[in_head]
                    classes = np.empty(len(words) + 3, np.int64)
                    classes[:2], classes[-1] = START, END
                    inner = classes[2:-1]
                    inner[in_head] = head_class[at]
                    if len(at) < len(words):
                        where = np.flatnonzero(~in_head)
                        own = [words[i] for i in where.tolist()]
                        own_class = [endings.get(w[-2:], REST) for w in own]
                        inner[where] = own_class
                        for w, n in Counter(own).items():
                            tails.append((key, w, n, endings.get(w[-2:], REST)))
                    u, v, w = classes[:-2], classes[1:-1], classes[2:]
                    score = float((near[v, w] + far[u, w] - norm[v, u]).sum(dtype=np.float64)) + float(head_inside[at].sum())
                    known = len(at) + (m.texts > 0)
                    n = len(words) + 1
                    out_rows.append((key, n, known, float(log_base[at].sum()) + end_base - n * base_norm, score))
                t = [list(x) for x in zip(*tails)] if tails else [[], [], [], []]
                cls = np.array(t[3], np.int64)
                pad = len(tails)
                done = [list(x) for x in zip(*out_rows)]
                k = len(out_rows)
                columns = [
                    done[0] + t[0], [None] * k + t[1], [None] * k + t[2], [None] * k + log_seen[cls].tolist(), [None] * k + log_unseen[cls].tolist(),
                    done[1] + [0] * pad, done[2] + [0] * pad, done[3] + [0.0] * pad, done[4] + [0.0] * pad,
                ]
                kept = [pa.concat_arrays([c.slice(lo, 512), pa.nulls(pad, c.type)]) for c in batch.columns[1:-1]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, kind in zip(columns, kinds)), *kept], names=[*names, *aside])

    types = dict(rows.dtypes)
    schema = "_row long, word binary, tf long, known double, unknown double, n_tokens long, n_known long, base_score double, score double"
    parts = write_shared(rows.mapInArrow(run, ", ".join([schema, *(f"{x} {types[x]}" for x in aside)])), "scores")
    whole = parts.filter(F.col("word").isNull()).select("_row", *aside, "n_tokens", "n_known", "base_score", "score")
    tail = parts.filter(F.col("word").isNotNull()).join(vocabulary, "word", "left")
    found = F.col("n").isNotNull()
    added = tail.groupBy("_row").agg(
        F.sum(F.when(found, F.col("tf")).otherwise(F.lit(0))).alias("k"),
        F.sum(F.when(found, F.col("tf") * F.log10(F.col("n") + 1.0)).otherwise(F.lit(0.0))).alias("b"),
        F.sum(F.col("tf") * F.when(found, F.log10(F.col("n").cast("double")) + F.col("known")).otherwise(F.col("unknown"))).alias("s"),
    )
    plus = lambda a, b, zero: (F.col(a) + F.coalesce(F.col(b), F.lit(zero))).alias(a)
    return whole.join(added, "_row", "left").select(
        *[F.col(x).alias(c) for c, x in zip(keep, aside)], "n_tokens", plus("n_known", "k", 0),
        F.lit(model.tokens).cast("long").alias("train_tokens"), plus("base_score", "b", 0.0), plus("score", "s", 0.0),
    )


def train_and_score(docs: DataFrame, train: Column, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Fit on the rows of ``docs`` where ``train`` holds, score all rows. With no row to learn from,
    every word is unseen and every class is as likely as another."""
    model, vocabulary = fit(docs.filter(train).select(text_col))
    return score_texts(docs, model, vocabulary, text_col, keep)
