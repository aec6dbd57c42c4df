"""Codes of vectors by codebooks for their parts, fitted by Lloyd's rounds with Elkan's bounds.

A vector's components are whole numbers, cut into equal parts; each part position has a codebook. For
each part of each vector an upper bound on the distance to its own entry and a lower bound on that to
each entry are kept in a table from round to round. Entries move when they become means; bounds follow
by the length of the move, and an entry is passed over where the bounds, or half the distance between
entries, show that it is strictly further. Distances of those that are left are whole numbers, so ties
are settled exactly. Lower bounds take a byte each, rounded down; upper ones are rounded up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.session import materialize, ship

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are compared at once.
STEP = 1024
#: Bounds are compared with this margin for the rounding of their own arithmetic.
SLACK = 1e-9
STATE = "vec_id long, label string, body binary, code binary, upper binary, lower binary"


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each entry."""
    most = 2 * max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if int(most) ** 2 * x.shape[1] < 1 << 53:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def pack_bounds(bound: np.ndarray) -> np.ndarray:
    """Lower bounds as bytes, rounded down: four bits of exponent and four of mantissa, 0 below 1."""
    bits = np.maximum(bound, 0).astype(np.float32)
    bits = np.where(bits > bound, np.nextafter(bits, np.float32(0)), bits).view(np.uint32) >> 19
    return np.clip(bits.astype(np.int64) - (127 << 4) + 1, 0, 255).astype(np.uint8)


def unpack_bounds(code: np.ndarray) -> np.ndarray:
    return _BOUNDS[code]


_BOUNDS = np.concatenate([[0.0], ((np.arange(255, dtype=np.uint32) + (127 << 4)) << 19).view(np.float32)]).astype(np.float64)


class Book:
    """The entries of one part position, and what Elkan's tests need of them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries = entries
        self.half = np.sqrt(squared(entries, entries).astype(np.float64)) / 2
        moved = np.zeros(len(entries), np.int64) if before is None else ((entries - before) ** 2).sum(1)
        self.moved = np.sqrt(moved.astype(np.float64)) * (1 + SLACK)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, upper bounds, lower bounds, distances computed) of rows that have no bounds yet."""
        far = squared(x, self.entries)
        root = np.sqrt(far.astype(np.float64))
        at = far.argmin(1)
        return at, root[np.arange(len(x)), at] * (1 + SLACK), pack_bounds(root * (1 - SLACK)), far.size

    def again(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the bounds of the round before."""
        rows = np.arange(len(x))
        upper = (upper + self.moved[at]) * (1 + SLACK)
        low = np.maximum(unpack_bounds(lower) - self.moved, 0)
        at, made = at.copy(), 0

        def left(of: np.ndarray) -> np.ndarray:
            near = (low[of] <= upper[of, None]) & (self.half[at[of]] * (1 - SLACK) <= upper[of, None])
            near[np.arange(len(of)), at[of]] = False
            return near

        some = np.flatnonzero(left(rows).any(1))
        own = ((x[some] - self.entries[at[some]]) ** 2).sum(1)
        made += len(some)
        root = np.sqrt(own.astype(np.float64))
        upper[some] = root * (1 + SLACK)
        low[some, at[some]] = root * (1 - SLACK)
        row, entry = np.nonzero(left(some))
        if len(row):
            far = ((x[some[row]] - self.entries[entry]) ** 2).sum(1)
            made += len(row)
            root = np.sqrt(far.astype(np.float64))
            low[some[row], entry] = root * (1 - SLACK)
            order = np.lexsort((entry, far, row))  # the nearest of each row, ties to the lower index
            best = order[np.append(True, row[order][1:] != row[order][:-1])]
            r, e, d = row[best], entry[best], far[best]
            won = (d < own[r]) | ((d == own[r]) & (e < at[some[r]]))
            at[some[r[won]]] = e[won]
            upper[some[r[won]]] = root[best[won]] * (1 + SLACK)
        return at, upper, pack_bounds(low), made


def _round_up(bound: np.ndarray) -> np.ndarray:
    near = bound.astype(np.float32)
    return np.where(near < bound, np.nextafter(near, np.float32(np.inf)), near)


def assign(body: np.ndarray, books: list[Book], state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, distances computed) of vectors (rows, parts, length)."""
    done = [b.first(body[:, p]) if state is None else b.again(body[:, p], *(s[:, p] for s in state)) for p, b in enumerate(books)]
    code, upper, lower, made = zip(*done)
    return np.stack(code, 1), np.stack(upper, 1), np.stack(lower, 1), sum(made)


def _table(col: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, *shape)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows[0].nbytes
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _kept(df: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    rows = common.pick(df, vec_id=ident, v=vector, label=label).select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"), F.col("label").cast("string"))
    return rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code as an array, error) of each kept row, and the codebooks by part position.

    The driver holds no more than the codebooks and the vectors that they begin with.
    """
    if not 1 <= entries <= 256 or rounds < 1:
        raise ValueError("there are 1 to 256 entries, and one round or more")
    spark = df.sparkSession
    ship(spark)
    kept = _kept(df, id_col, vector_col, label_col)
    longest, most = kept.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if longest is None:
        return spark.createDataFrame([], "vec_id long, label string, code array<int>, error long"), []
    length = -(-longest // parts)
    size = parts * length
    largest = (most or 0.0) * scale + 1
    if 4 * largest * largest * max(size, 1) >= 1 << 62:
        raise ValueError(f"components as large as {most} give errors beyond a long")
    kind = np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64
    padded = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v"))))
    first = padded.orderBy(F.col("vec_id").asc_nulls_last(), "v", F.col("label").asc_nulls_first()).limit(entries).select("v").collect()
    books = np.floor(np.array([r["v"] for r in first], np.float64).reshape(len(first), parts, length) * scale).astype(np.int64).transpose(1, 0, 2)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Book(b, None) for b in books]
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                b = batch.slice(i, STEP)
                body = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts, length) * scale).astype(np.int64)
                yield state(b.column(0), b.column(2), body, *assign(body, own, None)[:3])

    def state(ids: pa.Array, labels: pa.Array, body: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
        cols = [ids, labels, _binary(body.astype(kind)), _binary(code.astype(np.uint8)), _binary(_round_up(upper)), _binary(lower)]
        return pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "body", "code", "upper", "lower"])

    def bodies(b: pa.RecordBatch) -> np.ndarray:
        return _table(b.column(2), kind, parts, length).astype(np.int64) if length else np.zeros((b.num_rows, parts, 0), np.int64)

    def follow(now: np.ndarray, before: np.ndarray, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [Book(*x) for x in zip(now, before)]
            for batch in batches:
                for i in range(0, batch.num_rows, STEP):
                    b = batch.slice(i, STEP)
                    body = bodies(b)
                    old = _table(b.column(3), np.uint8, parts).astype(np.int64), _table(b.column(4), np.float32, parts).astype(np.float64), _table(b.column(5), np.uint8, parts, now.shape[1])
                    code, upper, lower, _ = assign(body, own, old)
                    if not last:
                        yield state(b.column(0), b.column(1), body, code, upper, lower)
                        continue
                    error = sum(((body[:, p] - now[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
                    codes = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * parts), pa.array(code.astype(np.int32).ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, pa.array(error)], names=["vec_id", "label", "code", "error"])

        return run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each entry that the task has met, and component; component -1 has the count."""
        total = np.zeros((parts * books.shape[1], length + 1), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                b = batch.slice(i, STEP)
                body = _table(b.column(0), kind, parts, length).astype(np.int64) if length else np.zeros((b.num_rows, parts, 0), np.int64)
                slot = _table(b.column(1), np.uint8, parts).astype(np.int64) + np.arange(parts) * books.shape[1]
                np.add.at(total, slot.ravel(), np.concatenate([np.ones((slot.size, 1), np.int64), body.reshape(slot.size, length)], 1))
        slot, comp = np.nonzero(total[:, :1] * np.ones(length + 1, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(comp - 1), pa.array(total[slot, comp])], names=["slot", "component", "total"])

    held = materialize(padded.mapInArrow(begin, STATE))
    for k in range(rounds):
        got = held.select("body", "code").mapInArrow(sums, "slot long, component long, total long")
        total = {(r[0], r[1]): r[2] for r in got.groupBy("slot", "component").agg(F.sum("total")).collect()}  # codebook-sized
        before, books = books, books.copy()
        for (slot, comp), s in total.items():
            if comp >= 0:
                books[slot // books.shape[1], slot % books.shape[1], comp] = s // total[slot, -1]
        last = k == rounds - 1
        got = held.mapInArrow(follow(books, before, last), "vec_id long, label string, code array<int>, error long" if last else STATE)
        held = materialize(got)
    return held, list(books)


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **how: int) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of each kept row.

    Rows whose vector is null or holds a null, a NaN or an infinity are dropped. Vectors that are
    shorter than the longest kept one, or whose length the parts don't divide, are filled up with
    zeros. Codebooks begin with the smallest ids, nulls last; rows with one id are ordered by vector.
    With fewer rows than entries there are as many entries as rows. Rows without an id or with a
    repeated one are coded like any other; null labels are summed together. An empty table gives an
    empty result; other columns are ignored. Components so large that an error might not fit a long
    raise an error.
    """
    coded, books = fit(df, id_col, vector_col, label_col, **how)
    told = ",".join(str(x) for b in books for e in b for x in e.tolist())
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(common.SALTS)).cast("int"))
    # A label may have a third of all rows: its sum goes back to salted parts.
    parts = salted.groupBy("label", "salt").agg(F.sum("error").alias("e"))
    whole = parts.groupBy(F.col("label").alias("of")).agg(F.sum("e").alias("label_error"))
    named = parts.join(whole, F.col("label").eqNullSafe(F.col("of"))).select(F.col("label").alias("of"), F.col("salt").alias("piece"), "label_error")
    return salted.join(named, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("piece"))).select(
        "vec_id",
        F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256"),
    )
