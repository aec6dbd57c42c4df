"""Fill-in-middle: texts cut at code points by a sparse index of checkpoints.

While the code points of a text are counted, the place of each EVERY-th one is recorded, as its number
and its byte. A cut finds the last checkpoint before it by binary search and reads on from there, at
most EVERY code points; so no table of all places is held and no text is decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.llm import common
from segmill.session import ship

EVERY = 256
#: Bytes that are classed at once while counting.
CHUNK = 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def _starts(some: np.ndarray) -> np.ndarray:
    """Where code points begin: bytes that go on with one are 10xxxxxx."""
    return np.flatnonzero((some & 0xC0) != 0x80)


class Checkpoints:
    """The number of code points in UTF-8 bytes, and the byte at which any of them begins."""

    def __init__(self, data: bytes, every: int = EVERY, chunk: int = CHUNK):
        self.data = np.frombuffer(data, np.uint8)
        self.n = 0
        marks = []
        for at in range(0, len(data), chunk):
            starts = _starts(self.data[at : at + chunk])
            marks.append(at + starts[-self.n % every :: every])
            self.n += len(starts)
        self.bytes = np.concatenate(marks) if marks else np.zeros(0, np.int64)
        self.points = np.arange(len(self.bytes)) * every

    def byte(self, k: int) -> int:
        """Of code point k; behind the last one, the number of bytes."""
        if k >= self.n:
            return len(self.data)
        j = int(np.searchsorted(self.points, k, "right")) - 1
        at, rest = int(self.bytes[j]), k - int(self.points[j])
        return at + int(_starts(self.data[at : at + 4 * (rest + 1)])[rest])


def draws(doc_id: int | None, salt: str) -> list[int]:
    """Four numbers of 32 bits that depend on the id and the salt alone."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest, ">u4", 4).tolist()


def rearrange(doc_id: int | None, data: bytes, salt: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, those of the prefix, those of the middle, output)."""
    index = Checkpoints(data)
    one, two, three, four = draws(doc_id, salt)
    if not data or three % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, data
    first, last = sorted((one % (index.n + 1), two % (index.n + 1)))
    a, b = index.byte(first), index.byte(last)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if four % 100 < spm:
        return index.n, "spm", first, last - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return index.n, "psm", first, last - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def put_back(output: bytes, form: str) -> bytes:
    """The text from which an output was made: no part of it holds a mark, so marks are found from the left."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    left, _, middle = output.removeprefix(one).partition(MIDDLE)
    first, _, second = left.partition(two)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1", rate: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row.

    Of 100 texts about `rate` are cut, and of these about `spm` have the suffix first; the choice and
    both cuts follow from the id and the salt. Null texts are empty; empty texts and those that hold a
    mark stay as they are. Rows without an id are drawn as if it were an empty string; repeated rows
    give repeated rows, an empty table none. A text may be of any length, and is held once with its
    output; other columns are ignored.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for ids, texts in common.by_bytes(batches, 1):
            done = [(i, *rearrange(i, t or b"", salt, rate, spm)) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    out = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The rows of fill_in_middle() with the text that was cut, as `restored`."""
    ship(df.sparkSession)
    at, kind = df.columns.index(output_col), df.columns.index(form_col)
    texts = df.withColumn(output_col, F.col(output_col).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [put_back(o.as_py(), f.as_py()) for o, f in zip(b.column(at), b.column(kind))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.binary())], names=[*b.schema.names, "restored"])

    out = texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("restored", T.BinaryType())]))
    return out.withColumns({c: F.col(c).cast("string") for c in (output_col, "restored")})


def digests(df: DataFrame) -> DataFrame:
    """Form, cuts and the digests of output and restored text of each document."""
    done = restore(fill_in_middle(df))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
