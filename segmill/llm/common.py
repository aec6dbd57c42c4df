"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, renamed, so that other columns can't clash."""
    return df.select(*[df[f"`{c}`"].alias(n) for n, c in cols.items()])


def keep_rows(df: DataFrame, text_col: str, judge: Callable[[], Callable[[list], list[bool]]], step: int = 128) -> DataFrame:
    """The rows, with all their columns, whose text passes; judge() gives the test to each task. No shuffle;
    runs of rows are bounded in bytes of text too."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = judge()
        for some in slices(batches, at, rows=step):
            kept = some.filter(pa.array(passes(some.column(at).to_pylist()), pa.bool_()))
            if kept.num_rows:
                yield kept

    return df.mapInArrow(run, df.schema)


def partition_id() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def attempt_id() -> int:
    ctx = TaskContext.get()
    return ctx.taskAttemptId() if ctx else 0


def rows(batches: Iterator[pa.RecordBatch], step: int = 500) -> Iterator[list[list]]:
    """Columns as lists, at most step rows at a time: bounds what is decoded at once."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield [c.to_pylist() for c in b.slice(i, step).columns]


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = 8 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in column `at` have about `most` bytes together. One longer value is a run
    of its own."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            before = int(ends[i - 1]) if i else 0
            j = min(max(int(np.searchsorted(ends, before + most, "right")), i + 1), i + rows)
            yield b.slice(i, j - i)
            i = j


def by_bytes(batches: Iterator[pa.RecordBatch], at: int, most: int = 8 << 20, rows: int = 4096) -> Iterator[list[list]]:
    """Columns as lists, of the runs of slices()."""
    for b in slices(batches, at, most, rows):
        yield [c.to_pylist() for c in b.columns]


def sorted_join(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, to be sorted and merged. Spark sizes what was exploded or is read
    from compressed files too low, and would else gather it on the driver to broadcast it."""
    return df.hint("merge")


def smallest_of_copies(df: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, salt) -> smallest ident of the key, and the size of its group.

    The key of a third of all rows is cut into SALTS parts, each counted on its own before the
    parts meet; the result has one row for each part, so the join back isn't skewed either.
    """
    parts = df.groupBy(key, salt(ident).alias("salt")).agg(F.min(ident).alias("low"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(key).agg(F.min("low").alias("first_id"), F.sum("n").alias("group_size"))
    return parts.select(key, "salt").join(whole, key)


def with_least(df: DataFrame, keys: list[str], value: str, of: str) -> DataFrame:
    """The rows with the smallest `value` of those with the same keys, as `least`, and their number as
    `members`. Keys are cut into SALTS parts by a hash of `of`, both for the count and for the join back."""
    salted = df.withColumn("salt", salt(of))
    parts = salted.groupBy(*keys, "salt").agg(F.min(value).alias("low"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(*keys).agg(F.min("low").alias("least"), F.sum("n").alias("members"))
    return salted.join(sorted_join(parts.select(*keys, "salt").join(sorted_join(whole), keys)), [*keys, "salt"]).drop("salt")


def salt(ident: str):
    return F.pmod(F.xxhash64(F.col(ident)), F.lit(SALTS)).cast("int")
