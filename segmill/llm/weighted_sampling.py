"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its shingles of five words, weighted by how often they occur
(fewer words: the whole sequence; no word: a term of its own). For each of SAMPLES positions every
term k gets draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) that depend on the term and the position alone;
with its weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1), and the position keeps the
(k, t) of the smallest a. Two documents agree at a position with probability sum(min w) / sum(max w),
their generalised Jaccard similarity, so the share of equal positions estimates it.

The next document of each row comes from one shuffle: ids are cut into exact ranges (id_ranges), each
range is sorted within its task, and the first row of a range is also sent to the range before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.llm.id_ranges import id_ranges
from segmill.session import ship

SHINGLE = 5
SAMPLES = 48
#: Bits kept of each sample; unequal samples agree by chance once in 65,536.
CELL = np.uint16
BLOCK = 1024
EMPTY = np.uint64(0x9AE16A3B2F90404F)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Sampler:
    def __init__(self, samples: int = SAMPLES, shingle: int = SHINGLE, most: int = 400_000):
        self.samples, self.shingle, self.most = samples, shingle, most
        self.seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * _MIX[2])
        self.words: dict[str, int] = {}

    def word_hashes(self, words: list[str]) -> np.ndarray:
        got = list(map(self.words.get, words))
        if None in got:
            if len(self.words) > self.most:
                self.words.clear()
            for i, h in enumerate(got):
                if h is None:
                    w = words[i]
                    got[i] = h = xxhash.xxh64_intdigest(w.encode())
                    if len(w) <= 64:
                        self.words[w] = h
        return np.array(got, np.uint64)

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """The hash of each shingle of these words, repeats included."""
        if not len(h):
            return np.array([EMPTY])
        n = min(self.shingle, len(h))
        out = mix(h[: len(h) - n + 1] + np.uint64(n))
        for k in range(1, n):
            out = mix(out * np.uint64(31) + h[k : len(h) - n + 1 + k])
        return out

    def draws(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t for each term and position."""
        x = mix(terms[:, None] ^ self.seeds[None, :])
        unit = np.float32(2.0**-32)
        half = np.float32(0.5)
        ln_c = np.log(-np.log(((x >> np.uint64(32)).astype(np.float32) + half) * unit * (((x & np.uint64(0xFFFFFFFF)).astype(np.float32) + half) * unit)))
        y = x * _MIX[2]
        y ^= y >> np.uint64(29)
        y *= _MIX[0]
        m = np.float32(2.0**-22)
        r = -np.log(((y >> np.uint64(42)).astype(np.float32) + half) * m * ((((y >> np.uint64(20)) & np.uint64(0x3FFFFF)).astype(np.float32) + half) * m))
        b = ((y & np.uint64(0xFFFFF)).astype(np.float32)) * np.float32(2.0**-20)
        if (weights == 1).all():
            return ln_c + r * (b - np.float32(1)), np.zeros(x.shape, np.int32)
        t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
        return ln_c - r * (t - b + np.float32(1)), t.astype(np.int32)

    def signature(self, groups: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each group of (terms, weights) the smallest ln a, its term and its cell at each position.
        Of equal ln a the smaller term counts; terms come in order."""
        out = []
        for terms, weights in groups:
            low = np.full(self.samples, np.inf, np.float32)
            term = np.zeros(self.samples, np.uint64)
            cell = np.zeros(self.samples, CELL)
            cols = np.arange(self.samples)
            for i in range(0, len(terms), BLOCK):
                k = terms[i : i + BLOCK]
                a, t = self.draws(k, weights[i : i + BLOCK])
                at = a.argmin(0)
                got = a[at, cols]
                new = got < low
                low, term = np.where(new, got, low), np.where(new, k[at], term)
                own = mix(k[at] ^ self.seeds ^ mix(t[at, cols].astype(np.int64).view(np.uint64)))
                cell = np.where(new, (own >> np.uint64(48)).astype(CELL), cell)
            out.append((low, term, cell))
        return out

    def weigh(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.shingles(words), return_counts=True)

    def fingerprint(self, text: str | None) -> np.ndarray:
        return self.signature([self.weigh(self.word_hashes(text.split() if text else []))])[0][2]

    def pair(self, text: str | None, edited: str | None, same: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Both fingerprints; what both texts have with the same weight is drawn once. Both begin with the
        same characters, as many as `same`; of the words within these only the last may differ."""
        first = self.word_hashes(text.split() if text else [])
        k = max(0, len(text[:same].split()) - 1) if text else 0
        second = np.concatenate([first[:k], self.word_hashes(edited.split()[k:] if edited else [])])
        a, b = self.weigh(first), self.weigh(second)
        both = np.concatenate([a[0], b[0]])
        count = np.concatenate([a[1], b[1]])
        order = np.lexsort((count, both))
        same = np.flatnonzero((both[order][1:] == both[order][:-1]) & (count[order][1:] == count[order][:-1]))
        one = np.ones(len(both), bool)
        one[order[same]] = one[order[same + 1]] = False
        n = len(a[0])
        shared = both[order[same]], count[order[same]]
        (s, st, sc), *own = self.signature([shared, (a[0][one[:n]], a[1][one[:n]]), (b[0][one[n:]], b[1][one[n:]])])
        first, second = (np.where((x < s) | ((x == s) & (xt < st)), xc, sc) for x, xt, xc in own)
        return first, second


def show(cells: np.ndarray) -> str:
    return cells.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_samplers: dict[tuple[int, int], Sampler] = {}


def sampler(samples: int, shingle: int) -> Sampler:
    if (samples, shingle) not in _samplers:
        _samplers[samples, shingle] = Sampler(samples, shingle)
    return _samplers[samples, shingle]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint of each row, without any shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(samples, shingle)
        for ids, texts in common.by_bytes(batches, 1, rows=500):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([show(s.fingerprint(t)) for t in texts], pa.string())], names=["doc_id", "fingerprint"])

    return common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, shingle: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next larger (doc_id, text); after the last comes the first, so
    a single document is its own next. Null texts count as empty and texts without a word share one
    fingerprint; null doc_id comes first. Repeated rows follow each other; rows of one doc_id (null
    too) beyond the size of a range are ordered by a hash of the text. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    docs = common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = id_ranges(docs.select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("weight")), parts=parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    h = F.xxhash64("text") if ranges.hot else F.lit(0).cast("long")
    ranged = ranges.with_part(docs.withColumn("h", h), "doc_id", F.col("h"))
    # The first row of each range that has rows: two numbers a range.
    first = {r["part"]: (r["low"], r["h"] if r["part"] in ranges.cut else None) for r in ranged.groupBy("part").agg(F.min("doc_id").alias("low"), F.min("h").alias("h")).collect()}
    have = sorted(first)
    if ranges.null and ranges.null[1] == 1:
        first[have[0]] = None, None
    known = spark.createDataFrame([(p, *first[p], have[k - 1]) for k, p in enumerate(have)], "part int, low long, low_h long, before int")
    leads = F.col("doc_id").eqNullSafe(F.col("low")) & F.coalesce(F.col("h") == F.col("low_h"), F.lit(True))
    rows = ranged.join(F.broadcast(known), "part").select(
        F.explode(F.when(leads, F.array(_own(F.col("part"), 0), _own(F.col("before"), 1))).otherwise(F.array(_own(F.col("part"), 0)))).alias("x"), "doc_id", "h", "text"
    ).select("x.*", "doc_id", "h", "text")
    dealt = rows.repartitionById(ranges.parts, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "h", "text").select("part", "guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(samples, shingle)
        open_ = None  # the last own row, which still waits for its next
        drawn = None  # the row before it and its fingerprint, which waits for the fingerprint of open_
        for cols in common.by_bytes(batches, 3, rows=200):
            out = []
            for p, guest, doc, text in zip(*cols):
                if open_ is not None:
                    row, own = _edited(s, open_[1], open_[2], text)
                    if drawn is not None:
                        out.append((*drawn[0], likeness(drawn[1], own)))
                    drawn = row, own
                elif guest:
                    continue  # another row that shares the smallest id of the next range
                if guest:
                    out.append((*drawn[0], likeness(drawn[1], s.fingerprint(text))))
                    drawn = None
                open_ = None if guest else (p, doc, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
        if open_ is not None:
            raise RuntimeError("a range without the first row of the next")

    return dealt.mapInArrow(run, OUT)


def _own(part, guest: int):
    return F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))


def _edited(s: Sampler, doc: int | None, text: str, following: str) -> tuple[tuple, np.ndarray]:
    """The row but for its last column, and its fingerprint."""
    changed = edit(text, following)
    own, other = s.pair(text, changed, len(text) - len(text) // 4)
    return (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), show(own), show(other), likeness(own, other)), own
