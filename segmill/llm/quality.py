"""Quality scores: random-indexing word vectors, pooled per document, and a small network in numpy.

Each word has a sparse ternary index vector that its hash determines. A word's vector is the sum of
the index vectors of its neighbours in the sample (WINDOW words to either side), damped and scaled to
length 1. A document is the mean of its words' vectors; a word that isn't among the frequent ones
counts as its shape (runs of capitals, small letters, digits and the marks themselves). Repetition
is told by three more words, which have index vectors like any other: one after each word that is
the same as the one before, one for each word that the document had already, and one for each such
line. A network
with one hidden layer is trained on labelled documents, and a temperature, fitted on a part of them
that the training left out, makes its output a calibrated probability.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, of texts of at most
language_id.SAMPLE_BYTES); all rows and whole texts are scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.llm.language_id import fits, held_out, sampled
from segmill.session import ship

SAMPLE_ROWS = 4000
WORDS = 4096
SHAPES = 512
SIZE = 96
NONZERO = 8
WINDOW = 2
HIDDEN = 32
EPOCHS = 400
THRESHOLD = 0.7
#: Words without any vector that each document is pooled with, so that a few words decide little.
PRIOR = 2.0
CACHE = 400_000


def shape(word: str) -> str:
    """Runs of capitals as A, of small letters as a, of digits as 9, of one mark as that mark."""
    out, last = [], ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if k != last:
            out.append(k)
            last = k
    return "\0" + "".join(out)


def index_vector(word: str) -> np.ndarray:
    """NONZERO places of +1 or -1."""
    v = np.zeros(SIZE, np.float32)
    for k in range(NONZERO):
        h = xxhash.xxh64_intdigest(word.encode(), k)
        v[(h >> 1) % SIZE] += 1.0 if h & 1 else -1.0
    return v


#: The words that tell of repetition. No text has them, as they hold white space.
MARKS = ("same as before", "had already", "line had already")


class Words:
    """Word to place in the table of vectors; the last place is for whatever is unknown."""

    def __init__(self, texts: list[str]):
        split = [t.split() for t in texts]
        count = Counter(w for ws in split for w in ws)
        shapes: Counter[str] = Counter()
        for w, n in count.items():
            shapes[shape(w)] += n
        first = lambda c, n: [w for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n] if k > 1]
        names = [*MARKS, *first(count, WORDS), *first(shapes, SHAPES)]
        self.at = {w: i for i, w in enumerate(names)}
        self.size = len(names) + 1
        self.cache: dict[str, int] = {}
        index = np.stack([*map(index_vector, names), np.zeros(SIZE, np.float32)])
        near = np.zeros(self.size * self.size, np.float32)  # how often two words are neighbours
        for ws in split:
            ids = self.ids(ws).astype(np.int64)
            for d in range(1, WINDOW + 1):
                key, n = np.unique(ids[:-d] * self.size + ids[d:], return_counts=True)
                near[key] += n
        near = near.reshape(self.size, self.size)
        sums = near @ index + near.T @ index
        sums = np.sign(sums) * np.log1p(np.abs(sums)) + index
        self.vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)

    def ids(self, words: list[str]) -> np.ndarray:
        got = list(map(self.at.get, words))
        if None in got:
            cache, unknown = self.cache, self.size - 1
            for i, v in enumerate(got):
                if v is None:
                    w = words[i]
                    v = cache.get(w)
                    if v is None:
                        v = self.at.get(shape(w), unknown)
                        if len(cache) >= CACHE:
                            cache.clear()
                        if len(w) <= 64:
                            cache[w] = v
                    got[i] = v
        return np.array(got, np.int32)

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """The mean vector of the words and marks."""
        counts = np.zeros((len(texts), self.size))
        n = np.zeros(len(texts))
        for k, t in enumerate(texts):
            words = t.split() if t else []
            if words:
                counts[k] = np.bincount(self.ids(words), minlength=self.size)
                n[k] = len(words)
                lines = t.split("\n")
                counts[k, : len(MARKS)] = sum(map(eq, words, words[1:])), len(words) - len(set(words)), len(lines) - len(set(lines))
        return counts @ self.vectors.astype(np.float64) / (n + PRIOR)[:, None]


class Network:
    """Two layers: tanh, then one logit. Full-batch Adam from a fixed start."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.std
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for k in range(1, EPOCHS + 1):
            h = np.tanh(x @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y) / len(y)
            back = d[:, None] * p[2] * (1 - h * h)
            grad = [x.T @ back + 1e-3 * p[0], back.sum(0), h.T @ d + 1e-3 * p[2], d.sum(keepdims=True)]
            for i, g in enumerate(grad):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        self.p = [a.astype(np.float32) for a in p]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.std) @ self.p[0].astype(np.float64) + self.p[1]) @ self.p[2].astype(np.float64) + self.p[3]


class Model:
    def __init__(self, texts: list[str], quality: list[int]):
        y = np.array(quality, np.float64)
        self.words, self.constant = None, None
        if len(set(quality)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.words = Words(texts)
        x = np.concatenate([self.words.pooled(texts[i : i + 256]) for i in range(0, len(texts), 256)])
        part = np.arange(len(y)) % 5 == 0
        if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
            part = np.ones(len(y), bool)
            self.net = Network(x, y)
        else:
            self.net = Network(x[~part], y[~part])
        z, t = self.net.logits(x[part]), y[part]
        self.temperature = min((0.5 * 1.2**i for i in range(20)), key=lambda s: float(np.mean(np.logaddexp(0, z / s) - t * z / s)))
        self.words.cache.clear()

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.words is None:
            return np.full(len(texts), self.constant)
        z = self.net.logits(self.words.pooled(texts)) / self.temperature
        # Rounded: how a text is batched changes only what lies beyond, so equal texts score equally.
        return (1 / (1 + np.exp(-np.clip(z, -60, 60)))).round(9)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows that aren't held out. A document with several labels has the largest."""
    known = common.pick(labels, doc_id="doc_id", quality="quality").filter(F.col("quality").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = sampled(known, "quality", sample).withColumnRenamed("doc_id", "label_id")
    docs = common.pick(df, doc_id=id_col, text=text_col).filter(fits())
    got = docs.join(F.broadcast(some), docs["doc_id"] == some["label_id"]).select(F.xxhash64("doc_id").alias("h"), "quality", "text").collect()
    got = sorted(((r["h"], r["quality"], r["text"] or "") for r in got))[: 2 * sample]
    return Model([t for _, _, t in got], [q for _, q, _ in got])


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Null texts count as empty; the empty text has the score of a document without words. Where no
    label or only one kind is known the score is its mean, 0.5 without any. Equal texts get equal
    scores, rounded to 9 places; a score of just the threshold is predicted 1. Repeated rows give repeated
    rows; texts may be of any length. An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model or fit(df, labels, id_col, text_col))  # bounded by WORDS x SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for ids, out, texts in common.by_bytes(batches, 2, rows=128):
            s = m.score(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    docs = common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(df: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The rows that score at least this much; all columns, no shuffle."""
    ship(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(model or fit(df, labels, id_col, text_col))
    return common.keep_rows(df, text_col, lambda: lambda texts: (known.value.score(texts) >= least).tolist())
