"""Text quality: random-indexing word vectors, pooled, under a small calibrated network.

Words are runs of letters, runs of digits and single signs; every word also counts as its
shape, and a word that repeats the one before it counts as a repeat.  Each of ``BUCKETS``
hashed words has a fixed sparse random index vector.  A word's vector is the sum of the
index vectors of its neighbours in the learning texts, scaled to length one.  A document is
the mean of its words' vectors.  A two-layer network maps that to a logit, and a
temperature fitted on texts the network did not see makes it a probability.

Learning uses ``SAMPLE`` labelled texts at most, those with the least hash of their id.
Scoring sees the whole of every text, and nothing but the text.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import pick, settled

#: Labelled texts that are learnt from at most.
SAMPLE = 6000
BUCKETS = 1 << 14
WIDTH = 64
NEAR = 2
HIDDEN = 24
EPOCHS = 60
SEED = 7
#: Share of every label that counts for the other one: keeps scores off 0 and 1.
SMOOTHING = 0.01
#: Tasks that learn from the labelled texts; each sends one sum for every word and place.
LEARNERS = 4
THRESHOLD = 0.7
#: Words whose bucket a task remembers.
MEMORY = 1 << 19

_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_SHAPES = ("upper", "title", "lower", "digits", "sign", "repeat")
_SHAPE_AT = {name: BUCKETS + i for i, name in enumerate(_SHAPES)}
ROWS = BUCKETS + len(_SHAPES)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text)


def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % BUCKETS


def counts_of(words: list[str], memory: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Vector rows and how often each counts, of a text's words, shapes and repeats."""
    if len(memory) > MEMORY:
        memory.clear()
    found: Counter[int] = Counter()
    upper = title = digits = sign = 0
    for word, n in Counter(words).items():
        at = memory.get(word)
        if at is None:
            kind = (
                3 if word.isdecimal() else 4 if not word.isalpha() else 0 if word.isupper() and len(word) > 1
                else 1 if word[:1].isupper() else 2
            )
            at = memory[word] = _bucket(word) * 8 + kind
        found[at >> 3] += n
        kind = at & 7
        if kind == 0:
            upper += n
        elif kind == 1:
            title += n
        elif kind == 3:
            digits += n
        elif kind == 4:
            sign += n
    repeat = sum(map(operator.eq, words, words[1:]))
    lower = len(words) - upper - title - digits - sign
    for name, n in zip(_SHAPES, (upper, title, lower, digits, sign, repeat), strict=True):
        if n:
            found[_SHAPE_AT[name]] += n
    return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.float32, len(found))


@dataclass
class QualityModel:
    """Word vectors and network; ``constant`` stands in where there was nothing to learn."""

    vectors: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    constant: float = 0.5

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(pooled), self.constant)
        w1, b1, w2, b2 = self.layers
        logit = np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -40, 40)))

    def pooled(self, texts: list[str], memory: dict[str, int]) -> np.ndarray:
        out = np.zeros((len(texts), WIDTH + len(_SHAPES)))
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                rows, n = counts_of(words, memory)
                out[i] = _pool(self.vectors, rows, n, len(words))
        return out


def _pool(vectors: np.ndarray, rows: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """Mean vector of the words, then the share of each shape."""
    shape = rows >= BUCKETS
    share = np.zeros(len(_SHAPES))
    share[rows[shape] - BUCKETS] = n[shape] / words
    return np.concatenate((n @ vectors[rows] / n.sum(), share))


def index_vectors() -> np.ndarray:
    """Sparse random vectors: four places of each are +1 or -1."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((ROWS, WIDTH), np.float32)
    at = rng.integers(0, WIDTH, (ROWS, 4))
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (ROWS, 4)), axis=1)
    return out


def sequence_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_bucket, words), np.int16, len(words))


def neighbour_sums(sequences: Iterable[np.ndarray]) -> np.ndarray:
    """Each word's sum of the index vectors of words up to ``NEAR`` places away.

    Whole numbers: sums of parts add up to the same in any order.
    """
    index, total = index_vectors().astype(np.int64), np.zeros((ROWS, WIDTH), np.int64)
    for seq in sequences:
        left = np.concatenate([seq[:-d] for d in range(1, NEAR + 1)])
        right = np.concatenate([seq[d:] for d in range(1, NEAR + 1)])
        word, other = np.concatenate((left, right)), np.concatenate((right, left))
        if not len(word):
            continue
        order = np.argsort(word, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(word[order]) != 0))
        total[word[order[at]]] += np.add.reduceat(index[other[order]], at, axis=0)
    return total


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """The sums at length one."""
    total = sums.astype(np.float32)
    # A shape has no place in the sequence: its own index vector stands for it.
    total[BUCKETS:] = index_vectors()[BUCKETS:]
    size = np.linalg.norm(total, axis=1, keepdims=True)
    return total / np.maximum(size, 1e-9)


def _train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two layers, cross entropy, Adam; the same result for the same input."""
    rng = np.random.default_rng(SEED)
    p = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            i = order[at : at + 128]
            h = np.tanh(x[i] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40)))
            d = (out - (y[i] * (1 - SMOOTHING) + SMOOTHING / 2)) / len(i)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[i].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def _temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least cross entropy."""
    tried, y = np.geomspace(0.05, 20, 121), y * (1 - SMOOTHING) + SMOOTHING / 2
    loss = [np.mean(np.logaddexp(0, logit / t) - y * logit / t) for t in tried]
    return float(tried[int(np.argmin(loss))])


def _constant(y: np.ndarray) -> QualityModel | None:
    """The model of labels that nothing can be learnt from."""
    if len(y) < 20 or y.min() == y.max():
        return QualityModel(constant=float((y.sum() + 1) / (len(y) + 2)))
    return None


def _learn(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> QualityModel:
    """The network over pooled texts; every fifth only fits the temperature."""
    model = QualityModel(vectors)
    kept = np.arange(len(y)) % 5 == 4
    model.mean, model.scale = x[~kept].mean(0), x[~kept].std(0) + 1e-6
    model.layers = _train((x[~kept] - model.mean) / model.scale, y[~kept])
    w1, b1, w2, b2 = model.layers
    model.temperature = _temperature(np.tanh((x[kept] - model.mean) / model.scale @ w1 + b1) @ w2 + b2, y[kept])
    return model


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    """A model from labelled texts in memory, as `fit_on` makes it."""
    y = np.array(labels, float)
    vectors = word_vectors(neighbour_sums(sequence_of(words_of(text)) for text in texts))
    return _constant(y) or _learn(vectors, QualityModel(vectors).pooled(texts, {}), y)


def held_out() -> Column:
    """Rows whose label is never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """A model from at most ``sample`` labelled rows of ``docs`` that are not held out.

    The texts stay on the executors: the driver gets sums by word and one pooled vector
    (`WIDTH` numbers and the shapes) for each text.
    """
    chosen = (
        pick(labels, doc_id="bigint", quality="int")
        .where("doc_id is not null and quality in (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    learnt = (
        pick(docs, doc_id="bigint", text="string")
        .join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers at most
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("quality").alias("quality"))
    )
    learnt = settled(learnt.repartition(LEARNERS), "learnt")
    spark = docs.sparkSession

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (text for batch in batches for text in batch["text"].to_pylist())
        total = neighbour_sums(sequence_of(words_of(text)) for text in texts)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i4").tobytes()])], ["sums"])

    total = np.zeros((ROWS, WIDTH), np.int64)
    for row in learnt.select("text").mapInArrow(sums, "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"], "<i4").reshape(ROWS, WIDTH)
    vectors = word_vectors(total)
    shared = spark.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = QualityModel(shared.value), {}
        for batch in batches:
            x = model.pooled(batch["text"].to_pylist(), memory)
            columns = [batch["doc_id"], batch["quality"], pa.array([one.tobytes() for one in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "x"])

    rows = learnt.mapInArrow(pooled, "doc_id bigint, quality int, x binary").collect()
    shared.destroy()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    y = np.array([r["quality"] for r in rows], float)
    return _constant(y) or _learn(vectors, np.array([np.frombuffer(r["x"]) for r in rows]), y)


def _scores(model: QualityModel, texts: list[str | None], memory: dict[str, int]) -> np.ndarray:
    if model.vectors is None:
        return np.full(len(texts), model.constant)
    return model.score(model.pooled([t or "" for t in texts], memory))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (probability of label 1) and ``predicted`` of every row.

    Null and empty texts score as the text without words.  Labels without an id or outside
    0 and 1 are not learnt from; an id with both labels counts as 0.  With fewer than 20
    labelled texts or only one label, every score is the smoothed share of label 1.  A
    null id has ``held_out`` as the empty text has.  Repeated rows are all returned; other
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            scores = _scores(model.value, batch["text"].to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = pick(docs, doc_id="bigint", text="string").mapInArrow(score, "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, sample))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            scores = _scores(model.value, batch["text"].to_pylist(), memory)
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(good, docs.schema)
