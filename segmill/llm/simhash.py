"""SimHash near-dedup by tiled exact comparison.

Fingerprints are linked if at most RADIUS bits differ. The comparison is exact: numpy compares a
tile of fingerprints with another by exclusive-or and bit counts, and skips the pair of tiles if
their population counts are further apart than the radius. Which tiles meet is settled without loss:
of `blocks` blocks of bits (by default two more than the radius), all but as many as the radius are
the same in two linked fingerprints, so tiles are made among fingerprints that share the bits of some
choice of so many blocks. A wider radius makes more and shorter keys: with 2 there are 6 of 32 bits,
with 6 there are 28 of 16, whose groups grow with the table; more blocks make longer keys. A group that
shares them and is larger than a tile is cut into tiles by population count and hash, and each pair
of tiles becomes a row of its own, so that no task holds a whole group.

Equal fingerprints are one node from the start. A pair of tiles gives a spanning forest of its links,
not all of them, which leaves the components as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.llm.components import components
from segmill.session import materialize, ship

SHINGLE = 3
RADIUS = 2
SEED = 42
TILE = 2048
#: Groups up to this size are compared all at once.
SMALL = 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: 64 bit counts per byte value and position are summed this many shingles at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, distinct: bool = False) -> int:
    """Of the text's shingles of words after lower-casing A-Z; a bit is 1 if over half the hashes have
    it. Fewer words than a shingle are hashed as one; no word gives zero. With `distinct`, of its distinct
    words, in any order."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    if distinct:
        words = sorted(set(words))
    body = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(body, SEED)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *end[: -shingle].tolist()]
    ends = (end[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    seen = 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        some = b"".join([digest(body[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])])
        bits = np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1)
        seen += len(bits)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > seen).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """(doc_id, row, fp) with the row's own number and the fingerprint as a signed long."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = common.partition_id() << 36
        for ids, texts in common.by_bytes(batches, 1):
            fps = np.array([fingerprint(t, shingle, distinct) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(range(row, row + len(ids)), pa.int64()), pa.array(fps)], names=["doc_id", "row", "fp"])
            row += len(ids)

    return common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, row long, fp long")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def tile_links(fps: np.ndarray, other: np.ndarray | None, radius: int, tile: int = 512) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest: within fps, or between fps and other, as positions.

    Both sides are sorted by population count and compared tile by tile; pairs of tiles whose counts
    lie further apart than the radius are skipped, as the distance is at least the difference.
    """
    a, own = np.asarray(fps, np.uint64), other is None
    b = a if own else np.asarray(other, np.uint64)
    pa_, pb = np.bitwise_count(a), np.bitwise_count(b)
    ia = np.argsort(pa_, kind="stable")
    ib = ia if own else np.argsort(pb, kind="stable")
    forest = Forest(len(a) + (0 if own else len(b)))
    shift = 0 if own else len(a)
    for x in range(0, len(a), tile):
        ax = ia[x : x + tile]
        lo, hi = int(pa_[ax[0]]), int(pa_[ax[-1]])
        for y in range(x if own else 0, len(b), tile):
            by = ib[y : y + tile]
            if int(pb[by[0]]) - hi > radius:
                break
            if lo - int(pb[by[-1]]) > radius:
                continue
            near = np.bitwise_count(a[ax][:, None] ^ b[by][None, :]) <= radius
            if own and x == y:
                near = np.triu(near, 1)
            for i, j in zip(*np.nonzero(near)):
                i, j = int(ax[i]), int(by[j])
                if forest.join(i, j + shift):
                    yield i, j


def bands(radius: int, blocks: int) -> list[int]:
    """The masks of the choices of blocks of which two fingerprints within the radius share one."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(one, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


LINKS = "a long, b long"


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, side, node, fp) of whole groups, from rows (band, key, part, side, node, fp) sorted by the
    first three, a batch at a time; starts has one more for the end."""
    held: list[np.ndarray] | None = None
    for b in chain(batches, [None]):
        if b is not None:
            cols = [c.to_numpy() for c in b.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if held is None or not len(held[0]):
            continue
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in held[:3]]))
        starts = np.append(np.flatnonzero(new), len(new))
        if b is not None:
            starts = starts[:-1]  # the last group may go on
        end = starts[-1]
        if end:
            yield starts, *(c[:end] for c in held[3:])
        held = [c[end:] for c in held]


def near_in_groups(starts: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within groups as positions: those of all small groups at once, then tile by tile."""
    size = np.diff(starts)
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    at = np.repeat(starts[small] - np.cumsum(size[small]) + size[small], size[small]) + np.arange(size[small].sum())
    ends = np.repeat(starts[small] + size[small], size[small])
    for step in range(1, int(size[small].max(initial=1))):
        go = at + step < ends
        at, ends = at[go], ends[go]
        near = np.flatnonzero(np.bitwise_count(fps[at] ^ fps[at + step]) <= radius)
        yield at[near], at[near] + step
    for g in np.flatnonzero(size > SMALL).tolist():
        a = starts[g]
        found = np.array(list(tile_links(fps[a : starts[g + 1]], None, radius)), np.int64).reshape(-1, 2)
        yield found[:, 0] + a, found[:, 1] + a


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between nodes (node, fp) with distinct fingerprints, enough for the components."""
    masks = bands(radius, blocks or radius + 2)
    keyed = nodes.select(
        "node",
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("x"),
    ).select("x.band", "x.key", F.bit_count("fp").alias("pop"), "node", "fp")
    grouped = common.with_least(keyed, ["band", "key"], "fp", "fp").filter("members > 1").drop("least").withColumnRenamed("members", "n")
    grouped = materialize(grouped)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, _, node, fp in _groups(batches):
            for i, j in near_in_groups(starts, fp.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, side, node, fp in _groups(batches):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                one, two = (a + np.flatnonzero(side[a:b] == k) for k in (0, 1))
                if len(one) and len(two):
                    found = np.array(list(tile_links(fp[one].view(np.uint64), fp[two].view(np.uint64), radius)), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(node[one[found[:, 0]]]), pa.array(node[two[found[:, 1]]])], names=["a", "b"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("band", "key", "part").sortWithinPartitions("band", "key", "part")

    small = grouped.filter(F.col("n") <= tile).select("band", "key", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), "node", "fp")
    big = grouped.filter(F.col("n") > tile)
    if not big.head(1):  # the driver then plans none of the joins below
        return dealt(small).mapInArrow(within, LINKS)
    # Groups beyond a tile: tiles of one population count, cut by hash to about `tile` rows.
    pops = materialize(big.groupBy("band", "key", "pop").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tile))).cast("int").alias("cuts")))
    mine = big.join(pops, ["band", "key", "pop"]).select(
        "band", "key", "pop", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int").alias("cut"), "node", "fp"
    )
    near = pops.select("band", "key", F.col("pop").alias("pop2"), F.col("cuts").alias("cuts2"))
    tiles = pops.select("band", "key", "pop", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    met = tiles.join(near, ["band", "key"]).filter(F.abs(F.col("pop") - F.col("pop2")) <= radius)
    met = met.select("band", "key", "pop", "cut", "pop2", F.explode(F.sequence(F.lit(0), F.col("cuts2") - 1)).alias("cut2"))
    mates = mine.join(common.sorted_join(met), ["band", "key", "pop", "cut"])
    first, second = F.struct("pop", "cut"), F.struct(F.col("pop2").alias("pop"), F.col("cut2").alias("cut"))
    label = F.concat_ws(":", F.least(first, second).cast("string"), F.greatest(first, second).cast("string"))
    # A tile pair's name as a number: should two names agree, their rows are compared together, which is as right.
    large = mates.select("band", "key", F.xxhash64(label).alias("part"), F.when(first <= second, 0).otherwise(1).alias("side"), (first == second).alias("alone"), "node", "fp")
    cols = ["band", "key", "part", "side", "node", "fp"]
    alone, crossed = large.filter("alone").select(*cols), large.filter("not alone").select(*cols)
    return (
        dealt(small.union(alone)).mapInArrow(within, LINKS).union(dealt(crossed).mapInArrow(between, LINKS))
    )


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    component_id is the smallest doc_id that links lead to, the row's own included. Texts without a
    word, null among them, have fingerprint zero and link like any other. Rows without doc_id take
    part in links but name no component by themselves: theirs is that of their fingerprint, null if
    all rows of the component have none. An empty table gives an empty result; repeated rows give
    repeated rows; other columns are ignored.
    """
    fps = materialize(fingerprints(df, id_col, text_col, shingle))
    # A fingerprint may have a third of all rows: they are counted and named in salted parts.
    salted = fps.withColumn("salt", common.salt("row"))
    parts = materialize(salted.groupBy("fp", "salt").agg(F.min("doc_id").alias("low")))
    nodes = materialize(parts.groupBy("fp").agg(F.min("low").alias("low")))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, blocks=blocks))  # nodes are named by their fingerprints
    linked = common.with_least(nodes.join(found.withColumnRenamed("node", "fp"), "fp"), ["component"], "low", "fp").select("fp", "least", "members")
    names = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("members").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    return salted.join(parts.select("fp", "salt").join(names, "fp"), ["fp", "salt"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
