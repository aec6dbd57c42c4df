"""L4: random forests without a limit of depth.

Nodes with many rows are split level by level from weighted class counts by (tree, node, feature, bin), summed
within tasks and then in one shuffle, as for boosting: with counts for gradients its gain is that of the Gini
index. Once a node's rows fit a task they are sent there, and the tree below is grown until its leaves
are pure. Such a forest is about as large as its data, so it is never gathered: the rows to be scored are sent
along, and only their scores leave the task. A bootstrap weight is a Poisson draw from the hash of row and
tree, the features tried at a node a draw from tree and node; so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.operators import boosting
from segmill.operators.boosting import BINS, Tree
from segmill.session import materialize, ship, spread

#: A node with at most this weight of rows is finished in one task.
SMALL = 200_000
BITS = 16
#: Rows in a record on their way to a tree.
RECORD = 64
#: Cumulated probabilities of 0, 1, ... draws of a row.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of hashes, by the seed."""
    h = h.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def draws(h: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in the tree's sample."""
    return np.searchsorted(_POISSON, (_mix(h, tree) >> np.uint64(11)) / float(1 << 53), "right")


def tried(tree: int, node: int, n: int) -> list[int]:
    """The features in the order in which the node tries them."""
    return np.argsort(_mix(np.arange(n, dtype=np.uint64) + np.uint64(node) * np.uint64(1 << 20), tree), kind="stable").tolist()


def gini_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, order: list[int], m: int) -> tuple[int, int, float] | None:
    """(feature, bin, decrease of the impurity) of the best split by the first m features of the order, and by
    further ones only while there is none; of equal ones the first feature, then the lowest bin."""
    all_n, all_p = w.sum(), w[y == 1].sum()
    best = None
    for k, f in enumerate(order):
        if k >= m and best is not None:
            break
        b = x[:, f]
        n, p = np.cumsum(np.bincount(b, w, BINS + 1)), np.cumsum(np.bincount(b, w * y, BINS + 1))
        at = np.flatnonzero((n > 0) & (n < all_n))
        if not len(at):
            continue
        n, p = n[at], p[at]
        gain = p * p / n + (all_p - p) ** 2 / (all_n - n) - all_p * all_p / all_n
        i = int(gain.argmax())
        if best is None or gain[i] > best[2] * (1 + 1e-12):
            best = f, int(at[i]), float(gain[i])
    return best


def _cells(x: np.ndarray, at: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells (node, bin) that have rows, as node * (BINS + 1) + bin in order, and the counts of both classes in each."""
    key = at * (BINS + 1) + x
    if n * (BINS + 1) <= 4 * len(key):
        sums = np.stack([np.bincount(key, c, n * (BINS + 1)) for c in counts])
        cells = np.flatnonzero(sums.any(0))
        return cells, sums[:, cells]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(counts[:, order], first, axis=1)


def _level_splits(x: np.ndarray, at: np.ndarray, counts: np.ndarray, order: np.ndarray, m: int, unit: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gini_split for all nodes of a level at once: (feature, bin, decrease of the impurity) of each; feature -1: no split.
    at: the node of each row; order: the features in the order in which each node tries them."""
    n_nodes = len(order)
    total = np.stack([np.bincount(at, c, n_nodes) for c in counts])
    feature, cut, best = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), np.zeros(n_nodes)
    for k in range(order.shape[1]):
        if k >= m:  # only for nodes without a split
            left = feature[at] < 0
            x, at, counts = x[left], at[left], counts[:, left]
        if not len(at):
            break
        cells, own = _cells(x[np.arange(len(x)), order[at, k]], at, counts, n_nodes)
        node = cells // (BINS + 1)
        run = np.cumsum(own, axis=1)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        run = run - np.repeat(run[:, first] - own[:, first], np.diff(np.append(first, len(node))), axis=1)
        inner = np.flatnonzero(np.append(node[1:] == node[:-1], False))
        if not len(inner):
            continue
        node, bins, run = node[inner], cells[inner] % (BINS + 1), run[:, inner]
        p, all_p = run[1] * unit[1], total[1, node] * unit[1]
        n, all_n = run[0] * unit[0] + p, total[0, node] * unit[0] + all_p
        gain = p * p / n + (all_p - p) ** 2 / (all_n - n) - all_p * all_p / all_n
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        top = np.maximum.reduceat(gain, first)
        hits = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(node)))))
        at_top = hits[np.append(True, node[hits][1:] != node[hits][:-1])]
        who = node[at_top]
        better = (feature[who] < 0) | (gain[at_top] > best[who] * (1 + 1e-12))
        who, at_top = who[better], at_top[better]
        feature[who], cut[who], best[who] = order[who, k], bins[at_top], gain[at_top]
    return feature, cut, best


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, root: int, depth: float, m: int, unit: tuple[float, float] = (1.0, 1.0)) -> Tree:
    """A tree whose leaves are pure or can't be split, or lie `depth` levels down; values are shares of class 1.

    All nodes of a level are split together. w times the class's unit is a row's weight: numbers of draws are summed
    without error, so a tree doesn't depend on the order of its rows.
    """
    t = Tree()
    nodes, names, level = np.zeros(1, np.int64), np.array([root], np.int64), 0
    at, counts = np.zeros(len(y), np.int64), np.stack([w * (y != 1), w * (y == 1)])
    while len(nodes):
        sums = np.stack([np.bincount(at, c, len(nodes)) for c in counts])
        p = sums[1] * unit[1]
        n = sums[0] * unit[0] + p
        for node, value in zip(nodes.tolist(), np.divide(p, n, out=np.zeros(len(n)), where=n > 0).tolist()):
            t.value[node] = value
        if level >= depth:
            break
        going = (p > 0) & (p < n)
        nodes, names, to = nodes[going], names[going], np.cumsum(going) - 1
        stay = going[at]
        x, at, counts = x[stay], to[at[stay]], counts[:, stay]
        if not len(nodes):
            break
        tries = _mix(np.arange(x.shape[1], dtype=np.uint64) + names[:, None].astype(np.uint64) * np.uint64(1 << 20), tree)
        feature, cut, gain = _level_splits(x, at, counts, np.argsort(tries, axis=1, kind="stable"), m, unit)
        made = np.flatnonzero(feature >= 0)
        below = [t.split(*s, (0.0, 0.0)) for s in zip(nodes[made].tolist(), feature[made].tolist(), cut[made].tolist(), [False] * len(made), gain[made].tolist())]
        to = np.cumsum(feature >= 0) - 1
        stay = feature[at] >= 0
        x, at, counts = x[stay], at[stay], counts[:, stay]
        right = x[np.arange(len(x)), feature[at]] > cut[at]
        at = 2 * to[at] + right
        nodes = np.array(below, np.int64).reshape(-1)
        names = (2 * names[made][:, None] + np.array([1, 2]) & 0xFFFFFFFF).reshape(-1)
        level += 1
    return t


def _bins(col: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, n)


def _upper_levels(data: DataFrame, trees: dict[int, Tree], weights: tuple[float, float], n: int, m: int, depth: float, small: int, rows: int) -> dict[int, dict[int, int]]:
    """Split nodes of more than `small` rows; the level of each node that is left open, by tree."""
    level = {k: {0: 0} for k in trees}
    big = {k: [0] for k in trees} if rows > small else {}
    unit = 2.0**-BITS
    while any(big.values()):
        nodes = {k: own for k, own in big.items() if own}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int, int], np.ndarray] = {}
            for b in batches:
                x, y, h = _bins(b.column(0), n), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
                for k, own in nodes.items():
                    leaf, times = trees[k].leaves(x), draws(h, k)
                    for node in own:
                        at = np.flatnonzero((leaf == node) & (times > 0))
                        w = np.rint(times[at] * np.where(y[at] == 1, weights[1], weights[0]) * 2.0**BITS)
                        for f in tried(k, node, n)[:m]:
                            got = np.stack([np.bincount(x[at, f], v, BINS + 1).astype(np.int64) for v in (w * y[at], w)])
                            sums[k, node, f] = sums[k, node, f] + got if (k, node, f) in sums else got
            out = [(np.full(len(at), k), np.full(len(at), node), np.full(len(at), f), at, *s[:, at]) for (k, node, f), s in sums.items() for at in [np.flatnonzero(s[1])]]
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cols[:4]), *map(pa.array, cols[4:])], names=["model", "node", "feature", "bin", "g", "h"])

        got = data.filter("split = 'train' AND y IS NOT NULL").select("x", "y", "_h").mapInArrow(run, boosting.HISTOGRAM)
        got = got.repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        splits = boosting.best_splits(got, {k: BITS for k in nodes}, boosting.Params(l2=0.0, least_weight=unit)).collect()  # a row a node
        big = {}
        for r in sorted(splits, key=lambda r: (r["model"], r["node"])):
            k, b = r["model"], r["best"]
            if b is None or level[k][r["node"]] >= depth:
                continue
            at = level[k].pop(r["node"])
            left = trees[k].split(r["node"], b["feature"], b["bin"], bool(b["missing"]), b["gain"], (0.0, 0.0))
            for node, weight in zip(left, (b["h_left"], r["h"] - b["h_left"])):
                level[k][node] = at + 1
                if weight > small and at + 1 < depth:
                    big.setdefault(k, []).append(node)
    return level


def forest_scores(
    df: DataFrame, columns: list[str], seeds: tuple[int, ...] = (0, 1, 2, 3, 4), trees: int = 100, depth: int | None = None, small: int = SMALL, keys: tuple[str, ...] = ("video_id", "segment_id")
) -> tuple[DataFrame, DataFrame]:
    """(seed, the keys, split, y, score) of every row, and (seed, importance by column) with importances as shares.

    Classes weigh alike; at each node the square root of the number of columns is tried. Missing values are
    larger than all others. Rows without a label are scored only; without training rows all scores are 0.
    """
    spark = df.sparkSession
    ship(spark)
    # Written once, evenly: tasks that deal rows out to the trees take as long as they have rows.
    df = materialize(spread(df.select(*keys, "split", "label", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]), *keys))
    train = (F.col("split") == "train") & F.col("label").isNotNull()
    n = df.filter(train).agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos")).first()
    neg, pos = max(n["neg"], 1), max(n["pos"], 1)
    weights = (neg + pos) / (2 * neg), (neg + pos) / (2 * pos)
    cuts = boosting.bin_bounds(df.filter(train), columns)
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    data = materialize(boosting._binned(hashed, columns, cuts, [F.lit(True)], [*keys, "_h"]).drop("used", "margin"))
    n_f, m, limit = len(columns), max(1, int(math.sqrt(len(columns)))), math.inf if depth is None else depth
    all_ = {s * trees + t: Tree() for s in seeds for t in range(trees)}
    levels = _upper_levels(data, all_, weights, n_f, m, limit, small, n["neg"] + n["pos"])
    names = data.columns
    x_at, h_at, y_at, s_at = (names.index(c) for c in ("x", "_h", "y", "split"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows once a tree, by the node they fall to: first as often as they are drawn, then to be scored. A record
        has up to RECORD rows, as what each costs Spark is far more than its bytes."""
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                x, h = _bins(b.column(x_at), n_f), b.column(h_at).to_numpy()
                learn = np.array([s == "train" and y is not None for s, y in zip(b.column(s_at).to_pylist(), b.column(y_at).to_pylist())], bool)
                y = np.array([v if v is not None else 0 for v in b.column(y_at).to_pylist()], np.int32)
                for k, t in all_.items():
                    leaf, times = t.leaves(x), draws(h, k)
                    rows = np.concatenate([np.flatnonzero(learn & (times > 0)), np.arange(len(h))])
                    role = np.repeat([0, 1], [len(rows) - len(h), len(h)])
                    by = np.lexsort((role, leaf[rows]))
                    rows, role = rows[by], role[by]
                    node = leaf[rows]
                    new = np.append(True, (node[1:] != node[:-1]) | (role[1:] != role[:-1]))
                    since = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
                    starts = np.flatnonzero(since % RECORD == 0)
                    ends = np.append(starts, len(rows))
                    cols = [pa.array(np.full(len(starts), k, np.int32)), pa.array(node[starts].astype(np.int32)), pa.array(role[starts].astype(np.int32))]
                    for v in (h[rows].astype(np.int64), y[rows], times[rows].astype(np.int32), x[rows]):
                        width = v.itemsize * (v.shape[1] if v.ndim > 1 else 1)
                        cols.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))]))
                    yield pa.RecordBatch.from_arrays(cols, names=["tree", "node", "role", "_h", "y", "times", "x"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Grow each node's tree from its drawn rows, then score the others by it, as they come."""
        at, held, grown = None, [], None

        def ready() -> Tree:
            rows = [np.concatenate(c) for c in zip(*held)] if held else [np.zeros((0, n_f), np.uint16), np.zeros(0), np.zeros(0)]
            return grow(*rows, at[0], at[1], limit - levels[at[0]].get(at[1], 0), m, weights)

        def gains(t: Tree) -> pa.RecordBatch:
            used = np.array(t.feature)
            sums = np.bincount(used[used >= 0], np.array(t.gain)[used >= 0], n_f).astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n_f, at[0] // trees, np.int32)), pa.array(np.arange(n_f)), pa.array(np.ones(n_f, np.int32)), pa.array(sums)], names=["seed", "key", "kind", "value"])

        for b in batches:
            tree, node, role = (b.column(k).to_numpy() for k in range(3))
            new = np.append(True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1]) | (role[1:] != role[:-1]))
            starts = np.append(np.flatnonzero(new), len(new))
            for a, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if at != (int(tree[a]), int(node[a])):
                    at, held, grown = (int(tree[a]), int(node[a])), [], None
                h, y, times = (np.frombuffer(b"".join(b.column(c).slice(a, e - a).to_pylist()), kind) for c, kind in ((3, np.int64), (4, np.int32), (5, np.int32)))
                x = _bins(b.column(6).slice(a, e - a), n_f)
                if not role[a]:
                    held.append((x, y, times))
                    continue
                if grown is None:
                    grown = ready()
                    held = []
                    yield gains(grown)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), at[0] // trees, np.int32)), pa.array(h), pa.array(np.zeros(len(h), np.int32)), pa.array(grown.values(x))], names=["seed", "key", "kind", "value"])

    rows = data.mapInArrow(deal, "tree int, node int, role int, _h binary, y binary, times binary, x binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = rows.repartition(parts, "tree", "node").sortWithinPartitions("tree", "node", "role").mapInArrow(finish, "seed int, key long, kind int, value double")
    done = materialize(done.groupBy("seed", "kind", "key").agg(F.sum(F.col("value").cast("decimal(30,18)")).cast("double").alias("value"), F.count(F.lit(1)).alias("n")))
    known = done.filter("kind = 0").select("seed", F.col("key").alias("_h"), (F.col("value") / F.col("n")).alias("score"))
    scores = data.drop("x").join(known, "_h").select("seed", *keys, "split", "y", F.col("score").cast("float").alias("score"))
    gain = done.filter("kind = 1").groupBy("seed").agg(F.sum("value").alias("all"), F.sort_array(F.collect_list(F.struct("key", "value"))).alias("each"))
    shares = F.transform("each", lambda e: F.when(F.col("all") > 0, e["value"] / F.col("all")).otherwise(0.0))
    return scores, gain.select("seed", shares.alias("importance"))
