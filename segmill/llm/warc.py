"""WARC: a deterministic sharded writer, and its reader.

Records are range-sorted by id. The ranges are exact: their bounds follow from the ids and payload
sizes alone, and a file's name from its range. So the same rows give the same files, whatever the
partitions of the input and of shuffles. Each task writes a range to files that it rolls by compressed
size, one gzip member a record. A file is written under a temporary name and renamed when it is
complete, unless a lost attempt of the same task left it; the manifest, a table that Spark commits as a whole,
lists the files that count with their digests, which readers check.

Headers and digests are made from the row alone (no clock, no random number).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.llm.id_ranges import id_ranges
from segmill.session import shared_dir, ship

FILE_BYTES = 256 << 20
#: A range has about 1/4,096 of the bytes, but not fewer or more than these.
RANGE_BYTES = 16 << 20, 1 << 30
RECORD_BYTES = 600
#: Payloads of fewer bytes are never revisits.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def target(url: str | None) -> str:
    """The url with white space, controls and what isn't ASCII percent-encoded, so that it stays one header line."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def sha256_label(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=").lower()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not compressed. A revisit has the block's HTTP head only."""
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {target(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: {sha256_label(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes a range's members to one file after another. A file is renamed to its own name when complete."""

    def __init__(self, base: str, part: int, most: int):
        self.fs, self.dir = pafs.FileSystem.from_uri(base)
        self.part, self.most, self.seq, self.out = part, most, 0, None
        self.fs.create_dir(f"{self.dir}/data", recursive=True)
        self.fs.create_dir(f"{self.dir}/tmp", recursive=True)

    def add(self, page_id: int | None, member: bytes) -> tuple | None:
        """The finished file's manifest row, if this record did not fit into it."""
        done = None
        if self.out and self.size + len(member) > self.most:
            done = self.close()
        if not self.out:
            self.name = f"part-{self.part:07d}-{self.seq:05d}.warc.gz"
            self.tmp = f"{self.dir}/tmp/{self.name}.{common.attempt_id()}"
            self.out = self.fs.open_output_stream(self.tmp, compression=None)
            self.size, self.n, self.sha, self.first = 0, 0, hashlib.sha256(), page_id
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.n += 1
        self.last = page_id
        return done

    def close(self) -> tuple | None:
        if not self.out:
            return None
        self.out.close()
        name = f"{self.dir}/data/{self.name}"
        there = self.fs.get_file_info(name)
        if there.type != pafs.FileType.NotFound and there.size == self.size:  # another attempt's, with the same bytes
            self.fs.delete_file(self.tmp)
        else:
            if there.type != pafs.FileType.NotFound:
                self.fs.delete_file(name)
            self.fs.move(self.tmp, name)
        self.out, self.seq = None, self.seq + 1
        return self.name, self.n, self.size, self.sha.hexdigest(), self.first, self.last


MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = ["file", "records", "bytes", "sha256", "first_id", "last_id"]


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload an earlier page has.

    Only digests are shuffled; a payload that very many pages share is cut into salted parts.
    """
    known = pages.filter(F.octet_length("html") >= LEAST).select("page_id", F.sha2("html", 256).alias("digest"))
    first = common.smallest_of_copies(known, "digest", "page_id").filter("group_size > 1").select("digest", "salt", "first_id")
    return (
        known.withColumn("salt", common.salt("page_id"))
        .join(first, ["digest", "salt"])
        .filter("page_id > first_id")
        .select("page_id", "digest", F.col("first_id").alias("refers_to"))
        .distinct()
    )


def write_warc(df: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write all rows below `out` and return the manifest.

    Null html is an empty payload, null url gives no target header, null page_id sorts first and has
    no id header. Rows of one page_id beyond a range's size are dealt out by their payload's digest. Of equal payloads of at least LEAST bytes the row with the smallest page_id is a
    response and those with larger ids revisit it; rows that share the smallest id are all responses.
    An empty table gives an empty manifest; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    pages = common.pick(df, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    sizes = pages.select(F.col("page_id").alias("id"), (F.octet_length("html") + RECORD_BYTES).cast("long").alias("weight"))
    ranges = id_ranges(sizes, parts=4096, least=RANGE_BYTES[0], most=RANGE_BYTES[1])
    # What a page revisits sorts just before the page's own row, so both meet in one shuffle.
    notes = revisits(pages).select("page_id", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    body = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    digest = F.xxhash64(F.when(F.col("kind") == 0, F.col("url")).otherwise(F.sha2("html", 256)))
    rows = ranges.with_part(notes.union(body), "page_id", digest)
    rows = rows.repartitionById(ranges.parts, F.col("part")).sortWithinPartitions("part", "page_id", "kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, known, of, done = None, {}, None, []
        for cols in common.by_bytes(batches, 3):
            for page_id, kind, url, html, refers_to, part in zip(*cols):
                if roller is None or part != roller.part:
                    done.append(roller and roller.close())
                    roller, known, of = Roller(out, part, file_bytes), {}, None
                if page_id != of:
                    known, of = {}, page_id
                if kind == 0:
                    known[url] = refers_to
                    continue
                payload = html.encode()
                ref = known.get(hashlib.sha256(payload).hexdigest()) if known else None
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                done.append(roller.add(page_id, z.compress(record(page_id, url, payload, ref, date)) + z.flush()))
        done = [x for x in [*done, roller and roller.close()] if x]
        cols = zip(*done) if done else [[]] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, _KINDS)], names=_NAMES)

    rows.mapInArrow(run, MANIFEST).write.json(f"{out}/manifest")
    fs, top = pafs.FileSystem.from_uri(out)
    if fs.get_file_info(f"{top}/tmp").type != pafs.FileType.NotFound:  # what lost attempts left
        fs.delete_dir_contents(f"{top}/tmp")
    return spark.read.schema(MANIFEST).json(f"{out}/manifest")


HEAD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


class Hashed:
    """A stream that digests what is read from it."""

    def __init__(self, stream):
        self.stream, self.sha = stream, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.sha.update(data)
        return data


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, part, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(READ)
            if not data:
                if part:
                    raise ValueError("the archive ends within a record")
                return
        part.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(part)
            z, part = zlib.decompressobj(31), []


def parse(member: bytes) -> dict:
    """Headers and payload of a record; its digests are computed anew and must agree."""
    at = member.index(b"\r\n\r\n") + 4
    if not member.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    first = member.index(b"\r\n") + 2
    head = {k.decode().lower(): v.decode() for k, v in HEAD.findall(member, first, at - 2)}
    n = int(head["content-length"])
    block = member[at : at + n]
    if len(block) != n or member[at + n :] != b"\r\n\r\n" or sha256_label(block) != head["warc-block-digest"]:
        raise ValueError(f"damaged record {head.get('warc-record-id')}")
    cut = block.index(b"\r\n\r\n") + 4
    size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", block[:cut])[1])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "response":
        payload = block[cut:]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload in {head.get('warc-record-id')}")
    else:
        payload = None
    number = lambda k: int(head[k]) if k in head else None
    return {
        "page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"],
        "refers_to": number("x-refers-to-page-id"), "target_uri": head.get("warc-target-uri"), "payload": payload,
    }


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(manifest: DataFrame, out: str, with_payload: bool = False) -> DataFrame:
    """The records of the files that the manifest lists; with_payload also target_uri and payload."""
    ship(manifest.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["target_uri", "payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(out)
        for cols in common.rows(batches):
            for f, sha256 in zip(*cols):
                held, size = [], 0
                with fs.open_input_stream(f"{top}/data/{f}", compression=None) as opened:
                    stream = Hashed(opened)
                    for m in members(stream):
                        held.append(parse(m))
                        size += len(m) if with_payload else 200
                        if size > 8 << 20:
                            yield _records(held, names, kinds)
                            held, size = [], 0
                if stream.sha.hexdigest() != sha256:
                    raise ValueError(f"{f} isn't what the manifest says")
                if held:
                    yield _records(held, names, kinds)

    ddl = RECORD + ", target_uri string, payload binary" * with_payload
    spread = max(1, manifest.count())
    return manifest.select("file", "sha256").repartition(min(spread, 100_000), "file").mapInArrow(run, ddl)


def _records(held: list[dict], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds)], names=names)


def round_trip(df: DataFrame) -> DataFrame:
    """Write the pages to a folder of the shared store and read the archives back."""
    out = shared_dir(df.sparkSession)
    return read_warc(write_warc(df, out), out)
