"""Exact dedup by a grace hash: buckets are split into spill files until each fits a table.

Texts are equal when identical after each run of ASCII white space became one space; null counts
as empty. The steps:

1. Each input task groups its own rows in an open-addressing table and writes one row for each
   distinct text, with the ids that have it. So a text that a third of all rows share reaches the
   shuffle once for each input task.
2. These rows are dealt out by the text's hash. A bucket's table compares complete contents and
   holds each once; beyond the memory bound it is split into spill files by further bits of the
   hash, again and again. Then the smallest id is picked.
3. The verdict goes back to each group of step 1 by the group's own id (one to one, no skew).

Step 1 is written to the shared folder, so that ids and verdicts come from one reading even where
an executor is lost in between.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.session import materialize, ship

LOCAL_BYTES = 48 << 20
LOCAL_IDS = 1 << 20
BUCKET_BYTES = 64 << 20
FAN_BITS = 4
SPACE = b" \t\n\x0b\x0c\r"


def normalise(text: str | None) -> bytes:
    """UTF-8 with each run of [\\x20\\x09-\\x0D] replaced by one space."""
    if not text:
        return b""
    b = text.encode()
    out = b" ".join(b.split())  # bytes.split knows just these six characters
    if not out:
        return b" "
    return (b" " if b[0] in SPACE else b"") + out + (b" " if b[-1] in SPACE else b"")


class ContentTable:
    """Open addressing with linear probing; entries are equal only if their whole contents are."""

    def __init__(self, bits: int = 10):
        self.clear(bits)

    def clear(self, bits: int = 10) -> None:
        self.mask = (1 << bits) - 1
        self.slots = [-1] * (1 << bits)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def entry(self, h: int, content: bytes) -> int:
        """The entry of this content, a new one if need be."""
        slots, mask, i = self.slots, self.mask, h & self.mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            i = (i + 1) & mask
        slots[i] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 5 * len(self.contents) > 3 * len(slots):
            self._grow()
        return e

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        self.mask, self.slots = size - 1, [-1] * size
        for e, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e


LOCAL = pa.schema(
    [("gid", pa.int64()), ("h", pa.int64()), ("content", pa.binary()), ("sha", pa.string()), ("low", pa.int64()), ("ids", pa.list_(pa.int64()))]
)
LOCAL_DDL = "gid long, h long, content binary, sha string, low long, ids array<long>"


def local_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of this task, its smallest id first among the ids."""
    table, members, seq, held = ContentTable(), [], 0, 0
    base = common.partition_id() << 36

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seq, held
        for i in range(0, len(table), 2000):
            own = range(i, min(i + 2000, len(table)))
            lists = []
            for e in own:
                ids = members[e]
                k = min(range(len(ids)), key=lambda j: (ids[j] is None, ids[j]))
                ids[0], ids[k] = ids[k], ids[0]
                lists.append(ids)
            contents = [table.contents[e] for e in own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + seq + j for j in range(len(own))], pa.int64()),
                    pa.array([table.hashes[e] - (1 << 63) for e in own], pa.int64()),
                    pa.array(contents, pa.binary()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in contents], pa.string()),
                    pa.array([ids[0] for ids in lists], pa.int64()),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                schema=LOCAL,
            )
            seq += len(own)
        table.clear()
        members.clear()
        held = 0

    for ids, texts in common.by_bytes(iter(batches), 1):
        for doc, text in zip(ids, texts):
            content = normalise(text)
            e = table.entry(xxhash.xxh64_intdigest(content), content)
            if e == len(members):
                members.append([])
            members[e].append(doc)
            held += 1
            if table.bytes > LOCAL_BYTES or held >= LOCAL_IDS:
                yield from flush()
    yield from flush()


Row = tuple[int, int, int | None, int, bytes]  # hash, gid, smallest id, rows, content
Member = tuple[int, int | None, int]  # gid, smallest id, rows
Verdict = tuple[int, int | None, int, int]


class Bucket:
    """Distinct contents, each once, with the rows that have it."""

    def __init__(self):
        self.table, self.members = ContentTable(), []
        self.size = 0

    def add(self, h: int, content: bytes, members: list[Member]) -> None:
        e = self.table.entry(h, content)
        if e == len(self.members):
            self.members.append([])
            self.size += len(content) + 100
        self.members[e] += members
        self.size += 100 * len(members)

    def drain(self) -> Iterator[tuple[int, bytes, list[Member]]]:
        """All entries; the bucket is empty then."""
        yield from zip(self.table.hashes, self.table.contents, self.members)
        self.__init__()

    def verdicts(self) -> Iterator[Verdict]:
        for own in self.members:
            _, _, keep, low = min((first is None, first or 0, gid, first) for gid, first, _ in own)
            n = sum(k for _, _, k in own)
            yield from ((gid, low, keep, n) for gid, _, _ in own)


def grace(rows: Iterable[Row], most: int | None = None) -> Iterator[Verdict]:
    """(gid, id that stays, its gid, size of the group) for each row."""
    return _grace(((h, content, [(gid, low, n)]) for h, gid, low, n, content in rows), 0, BUCKET_BYTES if most is None else most)


def _grace(entries: Iterable[tuple[int, bytes, list[Member]]], level: int, most: int) -> Iterator[Verdict]:
    """A bucket that grows beyond `most` bytes is emptied into spill files by the next bits of the hash,
    again and again until the entries end, and each file is dealt with alike. Equal contents meet in
    the table before they are spilled, so rows that share one content take its bytes once and some
    100 bytes each: with nothing else in the bucket they are never spilled again.
    """
    bucket, files = Bucket(), []
    shift = 64 - FAN_BITS * (level + 1)
    try:
        for entry in entries:
            bucket.add(*entry)
            if bucket.size > most and len(bucket.members) > 1 and shift >= 0:
                files = files or [tempfile.TemporaryFile() for _ in range(1 << FAN_BITS)]  # unlinked at once, so nothing is left behind
                _spill(bucket, files, shift)
        if not files:
            yield from bucket.verdicts()
            return
        _spill(bucket, files, shift)
        for f in files:
            f.seek(0)
            yield from _grace(_load(f), level + 1, most)
            f.close()
    finally:
        for f in files:
            f.close()


def _spill(bucket: Bucket, files: list, shift: int) -> None:
    for entry in bucket.drain():
        pickle.dump(entry, files[(entry[0] >> shift) & (len(files) - 1)], 5)


def _load(f) -> Iterator[tuple[int, bytes, list[Member]]]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


VERDICT = pa.schema([("gid", pa.int64()), ("keep_id", pa.int64()), ("keep_gid", pa.int64()), ("group_size", pa.int64())])
VERDICT_DDL = "gid long, keep_id long, keep_gid long, group_size long"


def bucket_verdicts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows of one task of the shuffle by hash."""

    def read() -> Iterator[Row]:
        for h, gid, low, n, content in common.by_bytes(iter(batches), 4):
            yield from ((a + (1 << 63), b, c, d, e) for a, b, c, d, e in zip(h, gid, low, n, content))

    out: list[tuple] = []
    for v in grace(read()):
        out.append(v)
        if len(out) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=VERDICT)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=VERDICT)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and empty texts are equal. Of equal texts the row with the smallest id
    stays (ids of null come last); where that id repeats, exactly one of its rows is kept. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    ship(df.sparkSession)
    src = common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    local = materialize(src.mapInArrow(local_groups, LOCAL_DDL))
    verdicts = (
        local.select("h", "gid", "low", F.size("ids").cast("long").alias("n"), "content")
        .repartition("h")
        .mapInArrow(bucket_verdicts, VERDICT_DDL)
    )
    return (
        local.select("gid", "sha", "ids")
        .join(common.sorted_join(verdicts), "gid")
        .select("gid", "sha", "keep_id", "keep_gid", "group_size", F.posexplode("ids").alias("pos", "doc_id"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("gid") == F.col("keep_gid")) & (F.col("pos") == 0)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
