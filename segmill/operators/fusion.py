"""A late-fusion network over branches of features, trained by Spark jobs.

Each branch is a vector column with layers of its own; what they give is put side by side and goes
through one more layer to a logit. An epoch is one job: tasks sum their rows' gradients, the sums of
all tasks are added in the order of partitions (so they don't depend on timing), and the driver, which
holds parameters only, takes a step. All runs of a study, seeds and sets of branches alike, go through
the same jobs. Positives weigh as much as there are negatives for each; every BLOCK epochs the area
under ROC on the validation split is computed for all of them, and a run stops when it has not grown
for `patience` epochs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.operators import metrics
from segmill.session import materialize, ship, spread

BLOCK = 5
#: Parameters that one row of a gradient holds.
CHUNK = 4096
STEP = 2048


class Params(NamedTuple):
    epochs: int = 60
    rate: float = 0.02
    decay: float = 0.01
    patience: int = 15
    hidden: int = 32
    branch: int = 32
    fused: int = 32


Layers = dict[str, tuple[np.ndarray, np.ndarray]]


def start(sizes: dict[str, int], p: Params, seed: int) -> Layers:
    """Fresh parameters for branches of these sizes."""
    rng = np.random.default_rng(seed)
    layer = lambda a, b: (rng.normal(0, math.sqrt(2 / max(a, 1)), (a, b)), np.zeros(b))
    out: Layers = {}
    for name, n in sizes.items():
        out[f"{name}/1"], out[f"{name}/2"] = layer(n, p.hidden), layer(p.hidden, p.branch)
    out["fused"], out["logit"] = layer(p.branch * len(sizes), p.fused), layer(p.fused, 1)
    return out


def forward(layers: Layers, x: dict[str, np.ndarray]) -> tuple[np.ndarray, list]:
    """Logits, and what the way back needs."""
    kept, parts = [], []
    for name, v in x.items():
        one = np.maximum(v @ layers[f"{name}/1"][0] + layers[f"{name}/1"][1], 0)
        two = np.maximum(one @ layers[f"{name}/2"][0] + layers[f"{name}/2"][1], 0)
        kept.append((name, v, one, two))
        parts.append(two)
    side = np.hstack(parts)
    fused = np.maximum(side @ layers["fused"][0] + layers["fused"][1], 0)
    return (fused @ layers["logit"][0] + layers["logit"][1])[:, 0], [kept, side, fused]


def gradient(layers: Layers, x: dict[str, np.ndarray], y: np.ndarray, weight: float) -> tuple[float, Layers]:
    """Sums over the rows of the weighted logistic loss and of its gradient."""
    z, (kept, side, fused) = forward(layers, x)
    w = np.where(y == 1, weight, 1.0)
    loss = float((w * (np.logaddexp(0, z) - y * z)).sum())
    d = (w * (1 / (1 + np.exp(-z)) - y))[:, None]
    out: Layers = {"logit": (fused.T @ d, d.sum(0))}
    d = d @ layers["logit"][0].T * (fused > 0)
    out["fused"] = side.T @ d, d.sum(0)
    d = d @ layers["fused"][0].T
    for k, (name, v, one, two) in enumerate(kept):
        own = d[:, k * two.shape[1] : (k + 1) * two.shape[1]] * (two > 0)
        out[f"{name}/2"] = one.T @ own, own.sum(0)
        own = own @ layers[f"{name}/2"][0].T * (one > 0)
        out[f"{name}/1"] = v.T @ own, own.sum(0)
    return loss, {k: out[k] for k in layers}


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in layers.values() for a in pair])


def unflat(v: np.ndarray, like: Layers) -> Layers:
    out, at = {}, 0
    for k, (w, b) in like.items():
        out[k] = v[at : at + w.size].reshape(w.shape), v[at + w.size : at + w.size + b.size]
        at += w.size + b.size
    return out


@dataclass
class Run:
    """One network of a study: its branches, its seed, its parameters after each epoch of the open block."""

    name: str
    seed: int
    branches: list[str]
    layers: Layers
    weight: float
    rows: float
    moments: list[np.ndarray] = field(default_factory=list)
    block: list[Layers] = field(default_factory=list)
    aucs: list[float] = field(default_factory=list)
    best: Layers | None = None

    def step(self, grad: np.ndarray, p: Params, k: int) -> None:
        """One step of Adam with decoupled weight decay."""
        v = flat(self.layers)
        if not self.moments:
            self.moments = [np.zeros_like(v), np.zeros_like(v)]
        g = grad / max(self.rows, 1.0)
        m, s = self.moments
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        v = v - p.rate * (m / (1 - 0.9**k) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8) + p.decay * v)
        self.layers = unflat(v, self.layers)
        self.block.append(self.layers)

    def judge(self, aucs: list[float], patience: int) -> bool:
        """Take the block's validation areas; whether to stop."""
        for layers, a in zip(self.block, aucs):
            if not self.aucs or not math.isnan(a) and not a <= max((x for x in self.aucs if not math.isnan(x)), default=-1.0):
                self.best = layers
            self.aucs.append(a)
        known = [a for a in self.aucs if not math.isnan(a)]
        if not known:
            self.best = self.block[-1] if self.block else self.best
        self.block = []
        return bool(known) and len(self.aucs) - 1 - self.aucs.index(max(known)) >= patience


def _vector(col: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in col.to_pylist()]) if len(col) else np.zeros((0, 0))


class Study(NamedTuple):
    runs: list[Run]
    branches: list[str]
    data: DataFrame

    def scores(self) -> DataFrame:
        """model, seed, the keys, split, y and score of every row and run."""
        n, names = len(self.data.columns) - len(self.branches), self.branches
        keys = self.data.columns[:n]
        runs = [(r.name, r.seed, r.branches, r.best or r.layers) for r in self.runs]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = {c: _vector(b.column(n + k)) for k, c in enumerate(names)}
                for name, seed, own, layers in runs:
                    if b.num_rows:
                        z, _ = forward(layers, {c: x[c] for c in own})
                        cols = [pa.array([name] * len(z)), pa.array(np.full(len(z), seed, np.int32)), *b.columns[:n], pa.array((1 / (1 + np.exp(-np.clip(z, -60, 60)))).astype(np.float32))]
                        yield pa.RecordBatch.from_arrays(cols, names=["model", "seed", *keys, "score"])

        kinds = dict(self.data.dtypes)
        return self.data.mapInArrow(run, "model string, seed int, " + ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", score float")


def _scaled(df: DataFrame, branches: dict[str, str], keys: tuple[str, ...]) -> tuple[DataFrame, dict[str, int]]:
    """Keys, split, y and the branches as binary vectors, scaled by the training rows; null components count as their mean."""
    sizes = df.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(f"_{k}") for k, c in enumerate(branches.values())]).first()
    size = {name: max(sizes[k], 0) for k, name in enumerate(branches)}
    train = df.filter("split = 'train'")
    stats = {}
    for name, c in branches.items():
        each = train.select(F.posexplode(F.transform(c, lambda v: v.cast("double")))).filter("col IS NOT NULL AND NOT isnan(col)")
        got = {r["pos"]: (r["m"], r["s"]) for r in each.groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()}
        stats[name] = np.array([got.get(k, (0.0, 0.0)) for k in range(size[name])]).reshape(size[name], 2)
    rows = df.select(*keys, "split", F.col("label").cast("int").alias("y"), *[F.transform(c, lambda v: v.cast("double")).alias(name) for name, c in branches.items()])
    n, names = len(keys) + 2, list(branches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, name in enumerate(names):
                mean, std = stats[name].T
                x = np.full((b.num_rows, size[name]), np.nan)
                for i, v in enumerate(b.column(n + k).to_pylist()):
                    if v:
                        x[i, : len(v)] = [np.nan if c is None else c for c in v]
                x = np.where(np.isfinite(x), x - mean, 0.0) / np.where(std > 0, std, 1.0)
                out.append(pa.array([r.tobytes() for r in x], pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *out], names=b.schema.names)

    kinds = dict(rows.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns[:n]) + "".join(f", `{c}` binary" for c in names)
    return materialize(rows.mapInArrow(run, ddl)), size


def _gradients(data: DataFrame, runs: list[tuple[list[str], Layers, float]], branches: list[str]) -> list[np.ndarray]:
    """Each run's gradient over the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: list[np.ndarray | None] = [None] * len(runs)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                b = batch.slice(i, STEP)
                y = b.column(0).to_numpy(zero_copy_only=False)
                x = {c: _vector(b.column(1 + k)) for k, c in enumerate(branches)}
                for k, (own, layers, weight) in enumerate(runs):
                    g = flat(gradient(layers, {c: x[c] for c in own}, y, weight)[1])
                    sums[k] = g if sums[k] is None else sums[k] + g
        part = TaskContext.get().partitionId()
        for k, s in enumerate(sums):
            if s is not None:
                cut = [s[i : i + CHUNK].tobytes() for i in range(0, len(s), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), k, np.int32)), pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(np.full(len(cut), part, np.int32)), pa.array(cut, pa.binary())], names=["run", "chunk", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:  # sorted by partition
            for k, c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                v = np.frombuffer(s, np.float64)
                total[k, c] = total[k, c] + v if (k, c) in total else v
        if total:
            ks, cs = zip(*total)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(cs, pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["run", "chunk", "sums"])

    parts = data.filter("split = 'train' AND y IS NOT NULL").select("y", *branches).mapInArrow(run, "run int, chunk int, part int, sums binary")
    got = parts.repartition("run", "chunk").sortWithinPartitions("part").mapInArrow(add, "run int, chunk int, sums binary").collect()  # as large as the parameters
    out = [np.zeros(len(flat(layers))) for _, layers, _ in runs]
    for r in got:
        v = np.frombuffer(r["sums"], np.float64)
        out[r["run"]][r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(v)] = v
    return out


def _areas(data: DataFrame, runs: list[tuple[list[str], list[Layers]]], branches: list[str]) -> dict[tuple[int, int], float]:
    """Area under ROC on the validation split by (run, epoch of the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = {c: _vector(b.column(1 + k)) for k, c in enumerate(branches)}
            for k, (own, block) in enumerate(runs):
                for e, layers in enumerate(block):
                    z, _ = forward(layers, {c: x[c] for c in own})
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), k, np.int32)), pa.array(np.full(len(z), e, np.int32)), b.column(0), pa.array(z)], names=["run", "epoch", "y", "score"])

    scores = data.filter("split = 'val' AND y IS NOT NULL").select("y", *branches).mapInArrow(run, "run int, epoch int, y int, score double")
    return {(r["run"], r["epoch"]): r["auc_roc"] for r in metrics.auc(scores, ["run", "epoch"]).collect()}


def fit(
    df: DataFrame, branches: dict[str, str], runs: dict[str, list[str]] | None = None, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), params: Params = Params(), keys: tuple[str, ...] = ("video_id", "segment_id")
) -> Study:
    """Train a network for each of the runs (name: branches; by default one with all) and seeds.

    `branches` names vector columns; components that are null, NaN or infinite, vectors that are null and
    what shorter ones lack count as the mean. Without a validation split of both classes all epochs count;
    without training rows the networks stay as they began. Rows without a label are scored only.
    """
    ship(df.sparkSession)
    runs = runs or {"fusion": list(branches)}
    if not all(runs.values()):
        raise ValueError("a run without a branch")
    # Written once, evenly, as each epoch reads these rows' tasks.
    df = materialize(spread(df.select(*keys, "split", "label", *[F.col(c).alias(f"_branch{k}") for k, c in enumerate(branches.values())]), *keys))
    data, size = _scaled(df, {name: f"_branch{k}" for k, name in enumerate(branches)}, keys)
    n = data.filter("split = 'train'").agg(F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y") == 1).alias("pos")).first()
    weight = n["neg"] / max(n["pos"], 1)
    all_ = [Run(name, s, own, start({b: size[b] for b in own}, params, s), weight, n["neg"] + n["pos"] * weight) for name, own in runs.items() for s in seeds]
    names, open_ = list(branches), list(all_)
    for k in range(1, params.epochs + 1):
        for r, g in zip(open_, _gradients(data, [(r.branches, r.layers, r.weight) for r in open_], names)):
            r.step(g, params, k)
        if k % BLOCK == 0 or k == params.epochs:
            areas = _areas(data, [(r.branches, r.block) for r in open_], names)
            stopped = [r.judge([areas.get((i, e), math.nan) for e in range(len(r.block))], params.patience) for i, r in enumerate(open_)]
            open_ = [r for r, s in zip(open_, stopped) if not s]
            if not open_:
                break
    return Study(all_, names, data)


def without_each(branches: list[str]) -> dict[str, list[str]]:
    """The runs of the branch ablation: all, and all but each."""
    out = {"fusion": branches}
    if len(branches) > 1:
        out |= {f"without:{b}": [c for c in branches if c != b] for b in branches}
    return out
