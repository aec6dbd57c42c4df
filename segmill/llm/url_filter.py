"""URL rules in a sorted digest array: memory-mapped 64-bit keys, probed by binary search.

The rules are packed in one file: sorted xxhash keys of the rules' hosts, sorted keys of the whole
rules (host and path), and the full strings. Spark sends the file to each executor, where a worker
maps it. A url's host suffixes are probed first; for those that are known, the prefixes of its path
of just the lengths that the rules of this host have. A key that is found counts only if the
stored string is the same, so collisions can't decide.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.session import ship

MOST_BYTES = 2 << 30
DEFAULT = "allow"
LOWER = {c: c + 32 for c in range(65, 91)}


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): both empty for null and where there is no `://`."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host, path = (rest[:end], "") if slash < 0 else (rest[:slash], rest[slash:end])
    return host.translate(LOWER), path


def digest(s: bytes) -> int:
    return xxhash.xxh64_intdigest(s)


def pack(rules: Iterable[Rule], hash_of=digest) -> bytes:
    """The file: the length of the longest host and counts, then sorted keys, offsets and verdicts, then the strings."""
    known = {}
    for r in rules:
        if r.verdict not in ("allow", "block"):
            raise ValueError(f"verdict {r.verdict!r}")
        known.setdefault((r.host.translate(LOWER), r.path), r.verdict)
    lengths: dict[bytes, set[int]] = {}
    for host, path in known:
        lengths.setdefault(host.encode(), set()).add(len(path))

    def table(entries: list[tuple[bytes, bytes]]) -> bytes:
        entries = sorted((hash_of(k), k, v) for k, v in entries)
        blob = [k + b"\0" + v for _, k, v in entries]
        keys = np.array([h for h, _, _ in entries], "<u8").tobytes()
        at = np.cumsum([0, *map(len, blob)], dtype="<u8").tobytes()
        return struct.pack("<QQ", len(entries), sum(map(len, blob))) + keys + at + b"".join(blob).ljust(-(-sum(map(len, blob)) // 8) * 8, b"\0")

    hosts = table([(h, np.array(sorted(n), "<u4").tobytes()) for h, n in lengths.items()])
    whole = table([(f"{h} {p}".encode(), v.encode()) for (h, p), v in known.items()])
    return struct.pack("<QQ", max((len(h) for h, _ in known), default=0), len(hosts)) + hosts + whole


class Index:
    """A mapped file of pack()."""

    def __init__(self, path: str, hash_of=digest):
        self.hash_of = hash_of
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.longest, n = struct.unpack_from("<QQ", self.map)
        self.hosts, self.rules = self._table(16), self._table(16 + n)

    def _table(self, at: int):
        n, size = struct.unpack_from("<QQ", self.map, at)
        at += 16
        keys = np.frombuffer(self.map, "<u8", n, at)
        off = np.frombuffer(self.map, "<u8", n + 1, at + 8 * n)
        return keys, off, at + 16 * n + 8

    def _probe(self, table, wanted: list[bytes]) -> list[bytes | None]:
        """What is stored for each string, by one vectorised binary search for all."""
        keys, off, base = table
        if not wanted or not len(keys):
            return [None] * len(wanted)
        hashes = np.fromiter(map(self.hash_of, wanted), "<u8", len(wanted))
        found = np.searchsorted(keys, hashes)
        out: list[bytes | None] = [None] * len(wanted)
        hit = np.flatnonzero(keys[np.minimum(found, len(keys) - 1)] == hashes)
        for i in hit.tolist():
            k, w = int(found[i]), wanted[i] + b"\0"
            while k < len(keys) and keys[k] == hashes[i]:  # all that share the key
                s = self.map[base + int(off[k]) : base + int(off[k + 1])]
                if s.startswith(w):
                    out[i] = s[len(w) :]
                    break
                k += 1
        return out

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule or None, verdict) of each url. The longest rule wins; of rules equally
        long, that with the longer host."""
        parts = [split_url(u) for u in urls]
        suffixes, owner = [], []
        for i, (host, _) in enumerate(parts):
            # A suffix longer than the longest rule host fits none; the next label begins after a dot.
            at = 0 if len(host) <= self.longest else host.find(".", len(host) - self.longest - 1) + 1 or len(host)
            while at < len(host):
                suffixes.append(host[at:])
                owner.append(i)
                at = host.find(".", at) + 1
                if not at:
                    break
        lengths = self._probe(self.hosts, [s.encode() for s in suffixes])
        wanted, of = [], []
        for s, i, got in zip(suffixes, owner, lengths):
            if got is not None:
                path = parts[i][1]
                for n in np.frombuffer(got, "<u4").tolist():
                    if n <= len(path):
                        wanted.append((s, path[:n]))
                        of.append(i)
        best: dict[int, tuple] = {}
        for (s, p), i, v in zip(wanted, of, self._probe(self.rules, [f"{s} {p}".encode() for s, p in wanted])):
            if v is not None:
                best[i] = max(best.get(i, ()), (len(s) + len(p), len(s), s + p, v.decode()))
        return [(h, p, best[i][2], best[i][3]) if i in best else (h, p, None, DEFAULT) for i, (h, p) in enumerate(parts)]


def publish(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Send the packed rules to all executors; its size is checked."""
    data = pack(rules)
    if len(data) > MOST_BYTES:
        raise ValueError(f"the rules take {len(data)} bytes; at most {MOST_BYTES} are sent to each executor")
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    sent = spark.sparkContext.__dict__.setdefault("_segmill_files", set())
    if name not in sent:
        path = os.path.join(tempfile.mkdtemp(prefix="segmill-"), name)
        with open(path, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(path)
        sent.add(name)
    return name


OUT = "page_id long, host string, path string, rule string, verdict string"


def judge_urls(df: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row, in one pass and without a shuffle.

    Host and path of a null url or one without `://` are empty, as is then the match: only a rule
    whose host is empty could fit, and none does. Repeated rows are judged alike; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    name = publish(spark, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for ids, urls in common.by_bytes(batches, 1):
            host, path, rule, verdict = zip(*index.judge(urls))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in (host, path, rule, verdict))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return common.pick(df, page_id=id_col, url=url_col).select(F.col("page_id").cast("long"), "url").mapInArrow(run, OUT)
