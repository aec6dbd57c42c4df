"""Gradient boosting by histograms, over all models of a study at once.

Features are cut into bins at quantiles; a row's bins are one binary value. For each level of a tree
one job sums gradients and second derivatives by (model, node, feature, bin), first within tasks, then
in one shuffle, and finds the best split of each node by windows over the bins; the driver gets one
row a node. Sums are over whole numbers (gradients times a power of two), so trees don't depend on
how rows are dealt out. Margins are written every BLOCK rounds, and the trees since then are evaluated
on the way. All models, say those of an ablation, grow in the same jobs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segmill.operators.ranges import running_before
from segmill.session import materialize, ship, spread

BINS = 256
MISSING = BINS
BLOCK = 10
#: A split must gain more than this.
LEAST_GAIN = 1e-6


class Params(NamedTuple):
    """The reference's settings of its learner and that learner's own defaults."""

    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    patience: int = 20
    l2: float = 1.0
    least_weight: float = 1.0


@dataclass
class Tree:
    """Nodes in the order they were made. feature -1: a leaf. Rows with a bin up to `bin` go left, those
    without a value where `left_if_missing` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left_if_missing: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, left_if_missing: bool, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.left_if_missing[node], self.left[node], self.gain[node] = feature, at, left_if_missing, a, gain
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left_if_missing.append(False)
            self.left.append(0)
            self.value.append(v)
            self.gain.append(0.0)
        return a, a + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, at, missing, left = (np.array(v) for v in (self.feature, self.bin, self.left_if_missing, self.left))
        node = np.zeros(len(x), np.int64)
        go = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(go):
            n = node[go]
            b = x[go, feature[n]]
            right = np.where(b == MISSING, ~missing[n], b > at[n])
            node[go] = left[n] + right
            go = go[feature[node[go]] >= 0]
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


@dataclass
class Model:
    """A model of a study: which features it has and, as it grows, its trees."""

    name: str
    features: list[int]
    weight: float
    bits: int
    trees: list[Tree] = field(default_factory=list)
    auc_pr: list[float] = field(default_factory=list)
    rounds: int = 0

    @property
    def best(self) -> int:
        """How many trees count: up to the first best round on the validation split, all if there is none."""
        known = [(-a, k) for k, a in enumerate(self.auc_pr) if not math.isnan(a)]
        return min(known)[1] + 1 if known else len(self.trees)

    def stopped(self, patience: int) -> bool:
        """Whether some round has been the best for `patience` rounds, as seen from each round in turn."""
        top, at = -math.inf, -1
        for k, a in enumerate(self.auc_pr):
            if math.isnan(a):
                return False
            if a > top:
                top, at = a, k
            elif k - at >= patience:
                return True
        return False

    def cut(self, patience: int) -> None:
        """Forget the rounds after the one that stopped."""
        for k in range(1, len(self.auc_pr) + 1):
            self.auc_pr, kept = self.auc_pr[:k], self.auc_pr
            if self.stopped(patience):
                self.trees = self.trees[:k]
                return
            self.auc_pr = kept


def bin_bounds(train: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """For each column the values up to which its bins reach, at most bins - 1: all but the largest
    distinct value where those are few, else approximate quantiles. NaN counts as missing."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns]
    got = train.agg(*[F.percentile_approx(v, at, 40 * bins).alias(f"q{k}") for k, v in enumerate(values)], *[F.max(v).alias(f"m{k}") for k, v in enumerate(values)]).first()
    out = []
    for k in range(len(columns)):
        cuts = np.unique(np.array(got[f"q{k}"] or [], np.float64))
        out.append(cuts[cuts < got[f"m{k}"]] if len(cuts) else cuts)
    return out


def _binned(df: DataFrame, columns: list[str], cuts: list[np.ndarray], uses: list[Column], keys: list[str]) -> DataFrame:
    """Keys, y, split, the row's bins (16 bits each), and which models train on it."""
    x = df.select(*keys, "split", F.col("label").cast("int").alias("y"), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x"), F.array(*[F.coalesce(u, F.lit(False)).cast("tinyint") for u in uses]).alias("used"))
    lead, n_models = len(keys) + 2, len(uses)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(lead).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(columns)) if b.num_rows else np.zeros((0, len(columns)))
            bins = np.stack([np.where(np.isnan(v[:, k]), MISSING, np.searchsorted(c, v[:, k], "left")) for k, c in enumerate(cuts)], 1).astype(np.uint16) if len(columns) else np.zeros((b.num_rows, 0), np.uint16)
            used = b.column(lead + 1).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(b.num_rows, n_models)
            yield pa.RecordBatch.from_arrays([*b.columns[:lead], _rows(bins), _rows(used), _rows(np.zeros((b.num_rows, n_models)))], names=[*b.schema.names[:lead], "x", "used", "margin"])

    kinds = dict(x.dtypes)
    return x.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in x.columns[:lead]) + ", x binary, used binary, margin binary")


def _rows(table: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in table], pa.binary())


def _matrix(col: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width) if width else np.zeros((len(col), 0), kind)


def gradients(margin: np.ndarray, y: np.ndarray, weight: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, positives weighted, as whole numbers of 2^-bits."""
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, weight, 1.0) * 2.0**bits
    return np.rint(w * (p - y)).astype(np.int64), np.rint(w * np.maximum(p * (1 - p), 1e-16)).astype(np.int64)


HISTOGRAM = "model int, node int, feature int, bin int, g long, h long"


def histograms(data: DataFrame, models: dict[int, Model], trees: dict[int, Tree], open_: dict[int, list[int]], done: int, n_models: int, n_features: int) -> DataFrame:
    """Sums by (model, open node, feature, bin) over the training rows. done: how many rounds the margins hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(m, f): np.zeros((2, len(open_[m]) * (BINS + 1)), np.int64) for m, model in models.items() for f in model.features}
        slots = {m: np.full(len(trees[m].feature), -1) for m in models}
        for m, own in slots.items():
            own[open_[m]] = np.arange(len(open_[m]))
        for b in batches:
            x, used, held, y = _matrix(b.column(0), np.uint16, n_features), _matrix(b.column(1), np.uint8, n_models), _matrix(b.column(2), np.float64, n_models), b.column(3).to_numpy(zero_copy_only=False)
            for m, model in models.items():
                rows = np.flatnonzero(used[:, m])
                slot = slots[m][trees[m].leaves(x[rows])]
                rows, slot = rows[slot >= 0], slot[slot >= 0]
                own, margin = x[rows], held[rows, m].copy()
                for t in model.trees[done:]:
                    margin += t.values(own)
                both = gradients(margin, y[rows], model.weight, model.bits)
                for f in model.features:
                    at = slot * (BINS + 1) + own[:, f]
                    for k, v in enumerate(both):
                        sums[m, f][k] += np.bincount(at, v, sums[m, f].shape[1]).astype(np.int64)
        out = []
        for (m, f), s in sums.items():
            at = np.flatnonzero(s[1])
            out.append((np.full(len(at), m), np.array(open_[m])[at // (BINS + 1)], np.full(len(at), f), at % (BINS + 1), *s[:, at]))
        if out:
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cols[:4]), *map(pa.array, cols[4:])], names=["model", "node", "feature", "bin", "g", "h"])

    got = data.filter("split = 'train'").select("x", "used", "margin", "y").mapInArrow(run, HISTOGRAM)
    # Tasks have summed their rows, so one shuffle serves these sums and the windows after them.
    return got.repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(sums: DataFrame, bits: dict[int, int], p: Params) -> DataFrame:
    """For each (model, node) its sums and the split that gains most, null without one; of equal gains the
    first feature, then the lowest bin, then missing values to the right."""
    unit = F.element_at(F.create_map(*[F.lit(v) for m, b in bits.items() for v in (m, 2.0**-b)]), F.col("model"))
    all_ = W.partitionBy("model", "node", "feature")
    upto = all_.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    there = F.col("bin") < MISSING
    x = sums.select(
        "*", unit.alias("unit"), *[F.sum(c).over(all_).alias(f"{c}_all") for c in "gh"], *[F.sum(F.when(there, F.col(c))).over(upto).alias(f"{c}_left") for c in "gh"],
        *[F.coalesce(F.sum(F.when(~there, F.col(c))).over(all_), F.lit(0)).alias(f"{c}_none") for c in "gh"],
    )
    x = x.withColumn("missing", F.explode(F.when(there & (F.col("h_none") > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    real = lambda c: c * F.col("unit")
    left = {c: real(F.col(f"{c}_left") + F.col("missing") * F.col(f"{c}_none")) for c in "gh"}
    x = x.select("model", "node", "feature", "bin", "missing", *[real(F.col(f"{c}_all")).alias(f"{c}_all") for c in "gh"], *[left[c].alias(f"{c}_left") for c in "gh"])
    right = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in "gh"}
    worth = lambda g, h: g * g / (h + F.lit(p.l2))
    gain = worth(F.col("g_left"), F.col("h_left")) + worth(right["g"], right["h"]) - worth(F.col("g_all"), F.col("h_all"))
    fit = there & (F.col("h_left") >= p.least_weight) & (right["h"] >= p.least_weight) & (right["h"] > 0) & (gain > LEAST_GAIN)
    what = F.struct("feature", "bin", "missing", gain.alias("gain"), "g_left", "h_left")
    first = F.struct(gain, -F.col("feature"), -F.col("bin"), -F.col("missing"))
    return x.groupBy("model", "node").agg(F.max("g_all").alias("g"), F.max("h_all").alias("h"), F.max_by(F.when(fit, what), F.when(fit, first)).alias("best"))


def auc_pr(scores: DataFrame, by: list[str]) -> DataFrame:
    """Area under precision by recall, from rows (by, score, p, n) of distinct scores. Between two scores
    false positives grow in proportion to true ones, so each piece is an integral in closed form."""
    totals = scores.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    x = running_before(running_before(scores, by, "score", "p", "p_below"), by, "score", "n", "n_below").join(totals, by)
    tp, fp = F.col("all_p") - F.col("p_below"), F.col("all_n") - F.col("n_below")
    before, a = tp - F.col("p"), F.lit(1.0) + F.col("n") / F.nullif(F.col("p"), F.lit(0.0))
    c = fp - F.col("n") - (a - 1) * before
    piece = F.col("p") / a - F.when(c == 0, 0.0).otherwise(c / (a * a) * F.log((a * tp + c) / F.nullif(a * before + c, F.lit(0.0))))
    none = F.lit(float("nan"))
    return x.groupBy(*by).agg(F.when((F.first("all_p") > 0) & (F.first("all_n") > 0), F.sum(F.when(F.col("p") > 0, piece)) / F.first("all_p")).otherwise(none).alias("auc_pr"))


def _validated(data: DataFrame, models: dict[int, Model], done: int, n_models: int, n_features: int) -> DataFrame:
    """(model, round, auc_pr) on the validation split, of the rounds that the margins don't hold yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, held, y = _matrix(b.column(0), np.uint16, n_features), _matrix(b.column(1), np.float64, n_models), b.column(2).to_numpy(zero_copy_only=False)
            for m, model in models.items():
                margin = held[:, m].copy()
                for k, t in enumerate(model.trees[done:], done):
                    margin += t.values(x)
                    score, at = np.unique(margin, return_inverse=True)
                    pos = np.bincount(at, y == 1, len(score))
                    rest = np.bincount(at, minlength=len(score)) - pos
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), m, np.int32)), pa.array(np.full(len(score), k, np.int32)), pa.array(score), pa.array(pos), pa.array(rest.astype(np.float64))], names=["model", "round", "score", "p", "n"])

    got = data.filter("split = 'val' AND y IS NOT NULL").select("x", "margin", "y").mapInArrow(run, "model int, round int, score double, p double, n double")
    return auc_pr(got.groupBy("model", "round", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["model", "round"])


def _with_margins(data: DataFrame, models: dict[int, Model], done: int, n_models: int, n_features: int) -> DataFrame:
    x_at, m_at = data.columns.index("x"), data.columns.index("margin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, margin = _matrix(b.column(x_at), np.uint16, n_features), _matrix(b.column(m_at), np.float64, n_models).copy()
            for m, model in models.items():
                for t in model.trees[done:]:
                    margin[:, m] += t.values(x)
            yield pa.RecordBatch.from_arrays([_rows(margin) if k == m_at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return data.mapInArrow(run, data.schema)


class Study(NamedTuple):
    """Grown models and the rows they score."""

    models: list[Model]
    columns: list[str]
    cuts: list[np.ndarray]
    data: DataFrame

    def scores(self) -> DataFrame:
        """The keys, split, y, model and score of every row and model, scores as probabilities."""
        models, n_features, keys = self.models, len(self.columns), self.data.columns[: self.data.columns.index("x")]
        x_at = len(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(x_at), np.uint16, n_features)
                for m in models:
                    margin = np.zeros(len(x))
                    for t in m.trees[: m.best]:
                        margin += t.values(x)
                    yield pa.RecordBatch.from_arrays([*b.columns[:x_at], pa.array([m.name] * len(x)), pa.array((1 / (1 + np.exp(-margin))).astype(np.float32))], names=[*keys, "model", "score"])

        kinds = dict(self.data.dtypes)
        return self.data.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", model string, score float")

    def importance(self, m: Model) -> list[float]:
        """Mean gain of the splits by each of the model's features, in parts of the sum."""
        total, count = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for t in m.trees[: m.best]:
            for f, gain in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += gain
                    count[f] += 1
        mean = (total / np.maximum(count, 1))[m.features]
        return (mean / (mean.sum() or 1.0)).tolist()


def boost(df: DataFrame, runs: dict[str, list[str]], where: dict[str, Column] | None = None, params: Params = Params(), keys: tuple[str, ...] = ("video_id", "segment_id")) -> Study:
    """Grow a model for each of the runs (name: columns) on the training rows, of which `where` may name a
    part by run, all at once.

    Positives weigh as much as there are negatives for each. A round is a tree of `depth` levels; a model
    stops where its area under precision by recall on the validation split hasn't grown for `patience`
    rounds, and only the trees up to its best round count. Values that are null or NaN are missing, and go
    where the gain is larger. Without training rows of both classes all scores are what the loss says of
    none; without a validation split of both classes all rounds count. Rows with a null label take no part
    in growing and are scored.
    """
    ship(df.sparkSession)
    columns = list(dict.fromkeys(c for own in runs.values() for c in own))
    train = (F.col("split") == "train") & F.col("label").isNotNull()
    used = [train & (where or {}).get(name, F.lit(True)) for name in runs]
    # Written once, evenly: features cost what their texts do, and every job of the study reads these rows' tasks.
    own = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    df = materialize(spread(df.select(*keys, "split", "label", *own, *[F.coalesce(u, F.lit(False)).alias(f"_used{i}") for i, u in enumerate(used)]), *keys))
    used = [F.col(f"_used{i}") for i in range(len(used))]
    n = df.agg(*[F.count_if(u & (F.col("label") == k)).alias(f"n{k}_{i}") for i, u in enumerate(used) for k in (0, 1)]).first()
    cuts = bin_bounds(df.filter(train), columns)
    data = first = materialize(_binned(df, columns, cuts, used, list(keys)))
    models = []
    for i, (name, own) in enumerate(runs.items()):
        neg, pos = n[f"n0_{i}"], n[f"n1_{i}"]
        weight = neg / max(pos, 1)
        bits = min(30, 61 - max(1, math.ceil(math.log2(max((neg + pos) * max(weight, 1.0), 2)))))
        models.append(Model(name, [columns.index(c) for c in own], weight, bits))
    growing = {i: m for i, m in enumerate(models) if m.features}
    done = 0
    for k in range(params.rounds):
        trees = {i: Tree() for i in growing}
        open_ = {i: [0] for i in growing}
        for _ in range(params.depth):
            left = {i: m for i, m in growing.items() if open_[i]}
            if not left:
                break
            got = best_splits(histograms(data, left, trees, open_, done, len(models), len(columns)), {i: m.bits for i, m in left.items()}, params).collect()
            open_ = {i: [] for i in growing}
            for r in sorted(got, key=lambda r: (r["model"], r["node"])):
                i, b = r["model"], r["best"]
                worth = lambda g, h: -params.rate * g / (h + params.l2)
                if r["node"] == 0:
                    trees[i].value[0] = worth(r["g"], r["h"])
                if b is not None:
                    values = worth(b["g_left"], b["h_left"]), worth(r["g"] - b["g_left"], r["h"] - b["h_left"])
                    open_[i] += trees[i].split(r["node"], b["feature"], b["bin"], bool(b["missing"]), b["gain"], values)
        for i, t in trees.items():
            models[i].trees.append(t)
        if (k + 1) % BLOCK == 0 or k + 1 == params.rounds:
            for r in sorted(_validated(data, growing, done, len(models), len(columns)).collect(), key=lambda r: r["round"]):
                models[r["model"]].auc_pr.append(r["auc_pr"])
            for i in [i for i, m in growing.items() if m.stopped(params.patience)]:
                growing.pop(i).cut(params.patience)
            if not growing:
                break
            if k + 1 < params.rounds:
                data = materialize(_with_margins(data, growing, done, len(models), len(columns)))
                done = k + 1
    return Study(models, columns, cuts, first)
