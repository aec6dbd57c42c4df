"""Near copies by HyperMinHash registers, confirmed on whole sets.

A document's set holds its distinct shingles of words. Each shingle is hashed once; its first bits name
one of REGISTERS buckets, and of the smallest rest in a bucket the number of leading zeros (6 bits) and
the next 10 bits are kept. Empty buckets take the register of another, drawn in an order that is the
same for all documents. Two sets agree in a register about as often as their Jaccard similarity says.

Four registers make a band; 32 bands are keys of 64 bits. A pair with a similarity of 0.8 shares none of
them with a chance of 5e-8. Documents that share a key are compared by all registers, corrected for
chance agreement; those that may be similar enough make clusters (spanning forests, then components),
and within a cluster links are confirmed on the full sets, so that none but true links count. Equal
sets are one node from the start.

Groups and clusters beyond a tile are split. A key that very many nodes share makes one cluster of them
without comparison; a large cluster is cut into tiles by set size and hash, linked within tiles, then
between one node of each part found so far, and only what is still apart is compared tile by tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.llm.components import components
from segmill.llm.simhash import LOWER
from segmill.session import materialize, ship

SHINGLE = 4
#: Sets are linked if they share at least so many hundredths of their union.
PERCENT = 80
REGISTERS, WIDTH = 128, 4
BANDS = REGISTERS // WIDTH
#: Pairs with a lower estimate are not confirmed: six deviations below PERCENT.
MARGIN = 25
#: Nodes, and bytes of text, of a tile.
TILE, TILE_BYTES = 2048, 16 << 20
SMALL = 16
SEED = 42
#: Sets that are linked differ by less than this factor in size.
STEP = 1.26

_BUCKETS = int(math.log2(REGISTERS))
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BUCKETS)
#: For each bucket, the order in which others are looked at if it is empty.
_ORDER = np.argsort(np.random.default_rng(SEED).random((REGISTERS, REGISTERS)), axis=1)
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * _MULTIPLY[1]
    h = (h ^ (h >> np.uint64(27))) * _MULTIPLY[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of words after lower-casing A-Z; fewer words are one
    shingle, none give an empty array. A word's hash enters with its place in the shingle."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out * _MULTIPLY[0] + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS numbers of 16 bits of a set that isn't empty, from its sorted hashes."""
    at = np.searchsorted(hashes, _BOUNDS)
    there = np.append(at[1:], len(hashes)) > at
    low = np.where(there, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0)) << np.uint64(_BUCKETS)
    # As a double, a number of 53 bits shows its leading zeros as its exponent.
    bits = (low >> np.uint64(11)).astype(np.float64).view(np.uint64)
    zeros = np.clip(1023 + 52 - (bits >> np.uint64(52)).astype(np.int64), 0, 63)
    out = (zeros << 10) | ((bits >> np.uint64(42)) & np.uint64(1023)).astype(np.int64)
    if not there.all():
        gaps = np.flatnonzero(~there)
        order = _ORDER[gaps]
        out[gaps] = out[order[np.arange(len(gaps)), there[order].argmax(1)]]
    return out.astype(np.uint16)


def estimate(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets of n and m elements of which so many registers agree. Registers of
    different elements agree by chance where both fall into one cell: with about 1/3 of 2^-10 for few
    elements a bucket, and 4 nm/(n+m)^2 of 0.17 times 2^-10 for many."""
    many = np.minimum(n, m) > REGISTERS
    chance = np.where(many, 0.17 * 4 * n * m / (n + m) ** 2, 1 / 3) / 1024
    return (same / REGISTERS - chance) / (1 - chance)


SIGNATURE = "doc_id long, row long, text string, n long, s1 long, s2 long, size long, keys array<long>"


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the row's own number, text, size of the set, digest of the set in two halves, bytes of the text,
    and the registers as keys: four to a number, null for an empty set."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = common.partition_id() << 36
        for ids, texts in common.by_bytes(batches, 1):
            sets = [shingles(t, shingle) for t in texts]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            keys = [registers(s).view(np.int64) if len(s) else None for s in sets]
            cols = [
                pa.array(ids, pa.int64()), pa.array(range(row, row + len(ids)), pa.int64()), pa.array(texts, pa.string()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "text", "n", "s1", "s2", "size", "keys"])
            row += len(ids)

    return common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNATURE)


def _groups(batches: Iterable[pa.RecordBatch], by: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(starts, rows) of whole groups, from rows sorted by the first `by` columns; starts has one more for the end."""
    held: pa.Table | None = None
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
        if held is None or not held.num_rows or b is not None and not b.num_rows:
            continue
        cols = [held.column(k).to_numpy() for k in range(by)]
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        starts = np.append(np.flatnonzero(new), len(new))
        if b is not None:
            starts = starts[:-1]  # the last group may go on
        if starts[-1]:
            yield starts, held.slice(0, int(starts[-1])).combine_chunks()
        held = held.slice(int(starts[-1]))


def _registers_of(t: pa.Table, name: str = "keys") -> np.ndarray:
    col = t.column(name).combine_chunks()
    return col.flatten().to_numpy().view(np.uint16).reshape(t.num_rows, REGISTERS)


def _near(regs: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, percent: float) -> np.ndarray:
    """Those of the others whose sizes allow the similarity with i and whose estimate is near it."""
    m = n[others]
    fit = others[100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])]
    same = (regs[fit] == regs[i]).sum(1)
    return fit[100 * estimate(same, n[i], n[fit]) >= percent - MARGIN]


class Labels:
    """Which positions are linked so far: positions with one label are."""

    def __init__(self, first: np.ndarray):
        self.of = np.array(first, np.int64)

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]

    def apart(self, i: int, among: np.ndarray) -> np.ndarray:
        return among[self.of[among] != self.of[i]]


def cluster_links(starts: np.ndarray, regs: np.ndarray, n: np.ndarray, percent: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that may be similar, enough to connect those of each group: all groups of up
    to SMALL at once, the others row by row."""
    size = np.diff(starts)
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    at = np.repeat(starts[small] - np.cumsum(size[small]) + size[small], size[small]) + np.arange(size[small].sum())
    ends = np.repeat(starts[small] + size[small], size[small])
    for step in range(1, int(size[small].max(initial=1))):
        go = at + step < ends
        at, ends = at[go], ends[go]
        a, b = n[at], n[at + step]
        fit = at[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
        for i in range(0, len(fit), 4096):
            x = fit[i : i + 4096]
            near = x[100 * estimate((regs[x] == regs[x + step]).sum(1), n[x], n[x + step]) >= percent - MARGIN]
            yield near, near + step
    for g in np.flatnonzero(size > SMALL).tolist():
        a, b = int(starts[g]), int(starts[g + 1])
        labels = Labels(np.arange(a, b))
        found = []
        for i in range(b - a - 1):
            left = labels.apart(i, np.arange(i + 1, b - a))
            if not len(left):
                if not i:
                    break
                continue
            for j in _near(regs[a:b], n[a:b], i, left, percent).tolist():
                if labels.of[i] != labels.of[j]:
                    labels.join(i, j)
                    found.append((a + i, a + j))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield pairs[:, 0], pairs[:, 1]


def similar(a: np.ndarray, b: np.ndarray, percent: float) -> bool:
    """Whether the sets share enough of their union."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def true_links(sets: list[np.ndarray], regs: np.ndarray, known: Labels, percent: float, cut: int | None = None) -> Iterator[tuple[int, int]]:
    """Links confirmed on sets, enough to connect all that are linked; `known` has what is, and is kept
    up to date. With `cut`, only pairs of a position before it and one from it on are compared."""
    n = np.array([len(s) for s in sets], np.int64)
    for i in range(len(sets) if cut is None else cut):
        for j in _near(regs, n, i, known.apart(i, np.arange(i + 1 if cut is None else cut, len(sets))), percent).tolist():
            if known.of[i] != known.of[j] and similar(sets[i], sets[j], percent):
                yield int(known.of[i]), int(known.of[j])
                known.join(i, j)


LINKS = "a long, b long"


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidates(nodes: DataFrame, percent: float = PERCENT, tile: int = TILE) -> DataFrame:
    """Links (a, b) between nodes (node, n, keys), enough that nodes which are similar are connected."""
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    shared = materialize(common.with_least(keyed, ["key"], "node", "node").filter("members > 1"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, t in _groups(batches, 1):
            node = t.column("node").to_numpy()
            for i, j in cluster_links(starts, _registers_of(t), t.column("n").to_numpy(), percent):
                yield _links(node[i], node[j])

    some = shared.filter(F.col("members") <= tile).select("key", "node").join(nodes, "node").select("key", "node", "n", "keys")
    found = some.repartition("key").sortWithinPartitions("key").mapInArrow(within, LINKS)
    return found.union(shared.filter((F.col("members") > tile) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b")))


def _tiles(clusters: DataFrame, facts: DataFrame, tile: int, most: int) -> DataFrame:
    """(node, component) -> component, tiles (their number if they were all alike), bucket and cut."""
    sized = clusters.join(facts, "node").withColumn("salt", common.salt("node"))
    parts = sized.groupBy("component", "salt").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("bytes"))
    weight = F.greatest(F.sum("k") / F.lit(float(tile)), F.sum("bytes") / F.lit(float(most)))
    whole = parts.groupBy("component").agg(F.ceil(weight).cast("int").alias("tiles"))
    placed = sized.join(parts.select("component", "salt").join(whole, "component"), ["component", "salt"]).drop("salt")
    bucket = F.floor(F.log("n") / F.lit(math.log(STEP))).cast("int")
    one = F.col("tiles") == 1
    return placed.select(
        "node", "component", "tiles", F.when(one, 0).otherwise(bucket).alias("bucket"),
        F.when(one, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("tiles"))).cast("int").alias("cut"),
    )


def _texts(placed: DataFrame, sigs: DataFrame) -> DataFrame:
    return placed.join(common.sorted_join(sigs.select(F.col("row").alias("node"), "text", "keys")), "node")


NAMED = "component long, bucket int, cut int, tiles int, node long, label long"


def confirm(clusters: DataFrame, sigs: DataFrame, percent: float = PERCENT, shingle: int = SHINGLE, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(node, label) of each node of the clusters (node, component): nodes that true links connect have one
    label, which is one of them."""
    facts = sigs.select(F.col("row").alias("node"), "n", "size")
    placed = _tiles(clusters, facts, tile, tile_bytes)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, t in _groups(batches, 3):
            node, regs = t.column("node").to_numpy(), _registers_of(t)
            label = node.copy()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                known = Labels(np.arange(b - a))
                sets = [shingles(x, shingle) for x in t.column("text").slice(a, b - a).to_pylist()]
                for _ in true_links(sets, regs[a:b], known, percent):
                    pass
                label[a:b] = node[a:b][known.of]
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("component", "bucket", "cut", "tiles", "node")), pa.array(label)], names=["component", "bucket", "cut", "tiles", "node", "label"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, t in _groups(batches, 1):
            regs, side, label = _registers_of(t), t.column("side").to_numpy(), t.column("label").to_numpy()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                cut = int((side[a:b] == 0).sum())  # rows are sorted by side
                if not 0 < cut < b - a:
                    continue
                sets = [shingles(x, shingle) for x in t.column("text").slice(a, b - a).to_pylist()]
                found = np.array(list(true_links(sets, regs[a:b], Labels(label[a:b]), percent, cut)), np.int64).reshape(-1, 2)
                yield _links(found[:, 0], found[:, 1])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, one, two in common.rows(batches, 64):
            keep = np.flatnonzero([similar(shingles(x, shingle), shingles(y, shingle), percent) for x, y in zip(one, two)])
            yield _links(np.array(a, np.int64)[keep], np.array(b, np.int64)[keep])

    dealt = _texts(placed, sigs).select("component", "bucket", "cut", "tiles", "node", "text", "keys").repartition("component", "bucket", "cut")
    named = materialize(dealt.sortWithinPartitions("component", "bucket", "cut").mapInArrow(within, NAMED))
    large = named.filter("tiles > 1")
    if not large.head(1):
        return named.select("node", "label")
    # One node of each part against one of its cluster.
    heads = large.filter(F.col("label") == F.col("node"))
    pivot = heads.groupBy("component").agg(F.min("node").alias("pivot"))
    body = common.sorted_join(sigs.select(F.col("row").alias("node"), "text"))
    pairs = heads.join(pivot, "component").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    pairs = pairs.join(body.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(body.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")
    linked = pairs.select("a", "b", "one", "two").mapInArrow(exact, LINKS).select(F.col("a").alias("label"), F.col("b").alias("pivot"))
    at = large.join(linked, "label", "left").select("component", "bucket", "cut", "node", F.coalesce("pivot", "label").alias("label"))
    at = materialize(at)
    small = named.filter("tiles = 1").select("node", "label")
    # Tiles that aren't known to be one part as a whole, pair by pair.
    tiles = at.groupBy("component", "bucket", "cut").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    one = tiles.select("component", *(F.col(c).alias(f"{c}1") for c in ("bucket", "cut", "low", "high")))
    two = tiles.select("component", *(F.col(c).alias(f"{c}2") for c in ("bucket", "cut", "low", "high")))
    met = one.join(two, "component").filter(
        (F.struct("bucket1", "cut1") < F.struct("bucket2", "cut2")) & (F.abs(F.col("bucket1") - F.col("bucket2")) <= 1)
        & ~((F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2")) & (F.col("low1") == F.col("low2")))
    ).withColumn("part", F.xxhash64("component", "bucket1", "cut1", "bucket2", "cut2"))
    met = materialize(met)
    if not met.head(1):
        return small.union(at.select("node", "label"))
    sides = [met.select("component", F.col(f"bucket{k}").alias("bucket"), F.col(f"cut{k}").alias("cut"), "part", F.lit(k - 1).alias("side")) for k in (1, 2)]
    dealt = _texts(at.join(common.sorted_join(sides[0].union(sides[1])), ["component", "bucket", "cut"]), sigs).select("part", "side", "node", "label", "text", "keys")
    across = dealt.repartition("part").sortWithinPartitions("part", "side").mapInArrow(between, LINKS)
    known = components(across).select(F.col("node").alias("label"), F.col("component").alias("root"))
    return small.union(at.join(known, "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: float = PERCENT, tile: int = TILE, tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    component_id is the smallest doc_id that links lead to, the row's own included; a row is kept if
    that is its own. Sets are equal if their 128-bit digests are, and shingles if their 64-bit hashes
    are. A text without a word, null among them, has an empty set and is linked with nothing. Fewer
    words than a shingle make one shingle. Rows without doc_id take part in links but name no component
    by themselves; where no row of a component has one, its id is null and its rows are kept, and so is
    each row without a word. Rows that share a doc_id are judged one by one. Texts may be of any length;
    a tile holds at least one. An empty table gives an empty result; other columns are ignored.
    """
    sigs = materialize(signatures(df, id_col, text_col, shingle))
    full = sigs.filter("n > 0")
    salted = full.select("doc_id", "row", "n", "s1", "s2").withColumn("salt", common.salt("row"))
    parts = salted.groupBy("s1", "s2", "salt").agg(F.min("doc_id").alias("low"), F.min("row").alias("node"))
    classes = materialize(parts.groupBy("s1", "s2").agg(F.min("low").alias("low"), F.min("node").alias("node")))
    firsts = classes.select("node")
    nodes = materialize(full.select(F.col("row").alias("node"), "n", "keys").join(firsts, "node", "left_semi"))
    clusters = components(candidates(nodes, percent, tile))
    found = confirm(clusters, full, percent, shingle, tile, tile_bytes)
    linked = common.with_least(classes.join(found, "node"), ["label"], "low", "node").select("node", "least", F.lit(True).alias("linked"))
    names = classes.join(linked, "node", "left").select("s1", "s2", F.when(F.col("linked"), F.col("least")).otherwise(F.col("low")).alias("component_id"))
    named = salted.join(parts.select("s1", "s2", "salt").join(names, ["s1", "s2"]), ["s1", "s2", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sigs.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
