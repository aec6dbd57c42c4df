"""Boosting by histograms against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.operators import boosting, models

COLS = ["a", "b", "c"]


def table(spark, n=260, seed=1, odd=True):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        a, b, c = rnd.randrange(12) / 4, rnd.gauss(0, 1), float(rnd.randrange(2))
        y = int(rnd.random() < (0.6 if a > 1.5 and b > 0 else 0.15))
        if odd and k % 9 == 0:
            a = None
        if odd and k % 13 == 0:
            b = float("nan")
        out.append((f"v{k % 17}", k, ("train", "train", "val", "test")[k % 4], y if not odd or k % 50 else None, a, b, c))
    return out, spark.createDataFrame(out, "video_id string, segment_id long, split string, label int, a double, b double, c double").repartition(3)


def naive_auc_pr(margin, y):
    """The area piece by piece, each in closed form."""
    total, area = y.sum(), 0.0
    tp = fp = 0.0
    for s in sorted(set(margin), reverse=True):
        p, n = float(((margin == s) & (y == 1)).sum()), float(((margin == s) & (y == 0)).sum())
        if p:
            steps = 20_000  # the middle of many small steps
            t = (np.arange(steps) + 0.5) / steps
            area += float(np.mean((tp + t * p) / (tp + t * p + fp + t * n))) * p
        tp, fp = tp + p, fp + n
    return area / total


def naive_boost(rows, columns, p, cuts):
    """One model by full enumeration of splits; (trees as nested tuples, margins of all rows by round)."""
    x = np.array([[np.nan if v is None else v for v in r[4:]] for r in rows])[:, [COLS.index(c) for c in columns]]
    bins = np.stack([np.where(np.isnan(x[:, k]), boosting.MISSING, np.searchsorted(cuts[k], x[:, k])) for k in range(len(columns))], 1)
    y = np.array([-1 if r[3] is None else r[3] for r in rows])
    train = np.array([r[2] == "train" and r[3] is not None for r in rows])
    neg, pos = int((y[train] == 0).sum()), int((y[train] == 1).sum())
    weight = neg / max(pos, 1)
    bits = min(30, 61 - max(1, math.ceil(math.log2(max((neg + pos) * max(weight, 1.0), 2)))))
    unit = 2.0**-bits
    margin = np.zeros(len(rows))
    trees, margins = [], []
    for _ in range(p.rounds):
        g, h = boosting.gradients(margin, y, weight, bits)
        out = np.zeros(len(rows))

        def grow(at, depth):
            own = at & train
            gt, ht = int(g[own].sum()) * unit, int(h[own].sum()) * unit
            best = None
            for f in range(len(columns)):
                b = bins[:, f]
                for cut in sorted(set(b[own]) - {boosting.MISSING}):
                    for missing in (0, 1):
                        left = at & ((b <= cut) & (b != boosting.MISSING) | (b == boosting.MISSING) & bool(missing))
                        gl, hl = int(g[left & train].sum()) * unit, int(h[left & train].sum()) * unit
                        gr, hr = gt - gl, ht - hl
                        if hl < p.least_weight or hr < p.least_weight:
                            continue
                        gain = gl * gl / (hl + p.l2) + gr * gr / (hr + p.l2) - gt * gt / (ht + p.l2)
                        if gain > boosting.LEAST_GAIN and (best is None or gain > best[0]):
                            best = gain, f, int(cut), missing, left
            if best is None or depth == p.depth:
                out[at] = -p.rate * gt / (ht + p.l2)
                return None
            _, f, cut, missing, left = best
            return f, cut, missing, grow(left, depth + 1), grow(at & ~left, depth + 1)

        trees.append(grow(np.ones(len(rows), bool), 0))
        margin = margin + out
        margins.append(margin)
    return trees, margins, y


def nested(t, node=0):
    if t.feature[node] < 0:
        return None
    return t.feature[node], t.bin[node], int(t.left_if_missing[node]), nested(t, t.left[node]), nested(t, t.left[node] + 1)


def test_trees_equal_brute_force(spark, monkeypatch):
    """Two models at once, with missing values and ties, across a checkpoint of margins."""
    monkeypatch.setattr(boosting, "BLOCK", 2)
    rows, df = table(spark)
    p = boosting.Params(rounds=3, depth=3, rate=0.3, patience=20)
    study = boosting.boost(df, {"all": COLS, "two": ["c", "a"]}, params=p)
    scores = {(r["model"], r["segment_id"]): r["score"] for r in study.scores().collect()}
    assert len(scores) == 2 * len(rows)
    for m, columns in zip(study.models, (COLS, ["c", "a"])):
        cuts = [study.cuts[COLS.index(c)] for c in columns]
        trees, margins, y = naive_boost(rows, columns, p, cuts)
        back = {COLS.index(c): k for k, c in enumerate(columns)}
        rename = lambda t: t and (back[t[0]], t[1], t[2], rename(t[3]), rename(t[4]))
        if columns == COLS:
            assert [nested(t) for t in m.trees] == trees
        val = np.array([r[2] == "val" and r[3] is not None for r in rows])
        want = [naive_auc_pr(np.round(mg[val], 12), y[val]) for mg in margins]
        assert m.auc_pr == pytest.approx(want, abs=1e-4)
        for r in rows:
            assert scores[m.name, r[1]] == pytest.approx(1 / (1 + math.exp(-margins[m.best - 1][r[1]])), abs=1e-6)
        assert sum(study.importance(m)) == pytest.approx(1.0)


def test_bins_reach_their_bounds(spark):
    _, df = table(spark, odd=False)
    cuts = boosting.bin_bounds(df, COLS)
    assert cuts[0].tolist() == [k / 4 for k in range(11)] and cuts[2].tolist() == [0.0]
    few = boosting.bin_bounds(df, COLS, 4)
    assert all(len(c) <= 3 for c in few)


def test_stop_by_patience():
    m = boosting.Model("m", [0], 1.0, 20, trees=[boosting.Tree() for _ in range(9)], auc_pr=[0.1, 0.3, 0.3, 0.2, 0.25, 0.1, 0.4, 0.1, 0.1])
    assert m.stopped(4) and not m.stopped(6)
    m.cut(4)
    assert (len(m.trees), m.best) == (6, 2)
    assert not boosting.Model("m", [0], 1.0, 20, auc_pr=[math.nan] * 30).stopped(20)


def test_odd_inputs(spark):
    """No training rows, one class, no validation rows, no columns."""
    rows, df = table(spark, 60)
    for some in (df.filter("split <> 'train'"), df.filter("label = 1"), df.filter("split <> 'val'"), df.limit(0)):
        study = boosting.boost(some, {"m": COLS, "none": []}, params=boosting.Params(rounds=2, depth=2))
        got = study.scores().collect()
        assert len(got) == 2 * some.count() and all(0 <= r["score"] <= 1 for r in got)


def test_ablation_and_curve_grow_together(spark):
    _, df = table(spark, 200, odd=False)
    got = {(r["kind"], r["category"]): r for r in models.ablation(df, {"x": ["a", "b"], "z": ["c"]}, models.boosted_trees, rounds=2, depth=2, seeds=(0, 1)).collect()}
    assert set(got) == {("without", "x"), ("without", "z"), ("only", "x"), ("only", "z")}
    assert got["only", "x"]["auc"] == pytest.approx(got["without", "z"]["auc"]) and got["only", "x"]["auc"] > got["only", "z"]["auc"]
    c = {r["fraction"]: r["n_positives"] for r in models.learning_curve(df, COLS, (0.3, 1.0), models.boosted_trees, rounds=2, depth=2, seeds=(0,)).collect()}
    assert c[1.0] == df.filter("split = 'train' AND label = 1").count() > c[0.3]


def test_seeds_share_the_scores(spark):
    _, df = table(spark, 120, odd=False)
    s, imp = models.boosted_trees(df, COLS, seeds=(3, 4), rounds=2, depth=2)
    by = {r["seed"]: r["s"] for r in s.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("segment_id", "score"))).alias("s")).collect()}
    assert by[3] == by[4] and s.columns == models.SCORE_COLUMNS and imp.count() == 2


# Late fusion.


def test_gradients_by_differences():
    from segmill.operators import fusion

    rng = np.random.default_rng(4)
    p = fusion.Params(hidden=4, branch=3, fused=5)
    layers = fusion.start({"a": 3, "b": 2}, p, 1)
    layers = fusion.unflat(fusion.flat(layers) + rng.normal(0, 0.1, len(fusion.flat(layers))), layers)
    x, y = {"a": rng.normal(size=(9, 3)), "b": rng.normal(size=(9, 2))}, rng.integers(0, 2, 9)
    _, g = fusion.gradient(layers, x, y, 2.5)
    v, g = fusion.flat(layers), fusion.flat(g)
    for k in range(len(v)):
        step = np.zeros(len(v))
        step[k] = 1e-6
        high, low = (fusion.gradient(fusion.unflat(v + s, layers), x, y, 2.5)[0] for s in (step, -step))
        assert g[k] == pytest.approx((high - low) / 2e-6, abs=1e-4)


def test_fusion_beats_its_best_branch(spark):
    """The label needs both branches; a third is noise, and vectors are missing or short here and there."""
    from segmill.operators import fusion, metrics

    rnd = random.Random(6)
    rows = []
    for k in range(900):
        a, b = [rnd.gauss(0, 1) for _ in range(3)], [rnd.gauss(0, 1) for _ in range(2)]
        y = int(a[0] + a[1] + 1.5 * b[0] + rnd.gauss(0, 0.5) > 1)
        rows.append((f"v{k % 31}", k, ("train", "train", "val", "test")[k % 4], y if k % 60 else None, a if k % 40 else None, b if k % 45 else b[:1], [rnd.gauss(0, 1), None]))
    df = spark.createDataFrame(rows, "video_id string, segment_id long, split string, label int, a array<double>, b array<double>, c array<double>").repartition(4)
    runs = {"fusion": ["a", "b", "c"], "only:a": ["a"], "only:b": ["b"]}
    study = fusion.fit(df, {"a": "a", "b": "b", "c": "c"}, runs, seeds=(0, 1), params=fusion.Params(epochs=20, hidden=8, branch=8, fused=8))
    s = study.scores()
    assert s.count() == 900 * 6 and s.columns == ["model", "seed", "video_id", "segment_id", "split", "y", "score"]
    auc = {(r["model"], r["seed"]): r["auc_roc"] for r in metrics.auc(s.filter("split = 'test' AND y IS NOT NULL"), ["model", "seed"]).collect()}
    for seed in (0, 1):
        assert auc["fusion", seed] > max(auc["only:a", seed], auc["only:b", seed]) + 0.02 and auc["fusion", seed] > 0.85
    assert fusion.without_each(["a", "b"]) == {"fusion": ["a", "b"], "without:a": ["b"], "without:b": ["a"]}
    for some in (df.filter("split <> 'train'"), df.filter("split = 'train'"), df.limit(0)):
        got = fusion.fit(some, {"a": "a"}, seeds=(0,), params=fusion.Params(epochs=1, hidden=2, branch=2, fused=2)).scores()
        assert got.count() == some.count()


def test_fusion_stops():
    from segmill.operators import fusion

    r = fusion.Run("m", 0, ["a"], {}, 1.0, 1.0, block=[{"k": i} for i in range(5)])
    assert not r.judge([0.5, 0.7, 0.6, math.nan, 0.65], 4) and r.best == {"k": 1}
    r.block = [{"k": i} for i in range(5, 10)]
    assert r.judge([0.7, 0.6, 0.6, 0.6, 0.6], 4) and r.best == {"k": 1}


# Forests.


def test_forest_is_pure_on_a_chain(spark):
    """A table that only a tree of over 30 levels separates: classes alternate along one column."""
    from segmill.operators import forest

    rows = [(f"v{k % 9}", k, "train" if k % 4 else "test", k // 4 % 2, float(k // 4), 1.0) for k in range(280)]
    df = spark.createDataFrame(rows, "video_id string, segment_id long, split string, label int, a double, b double")
    x = np.array([[k] for k in range(70)], np.uint16)
    t = forest.grow(x, np.arange(70) % 2, np.ones(70), 1, 0, math.inf, 1)
    assert (t.values(x) == np.arange(70) % 2).all()
    chain = np.array([[f > k for f in range(1, 41)] for k in range(41)], np.uint16)  # each split tells one row
    t = forest.grow(chain, np.arange(41) % 2, 2.0 ** -np.arange(41), 1, 0, math.inf, 40)
    level = {0: 0}
    for node, f in enumerate(t.feature):
        if f >= 0:
            level[t.left[node]] = level[t.left[node] + 1] = level[node] + 1
    assert (t.values(chain) == np.arange(41) % 2).all() and max(level.values()) > 30
    s, imp = forest.forest_scores(df, ["a", "b"], seeds=(0, 1), trees=20)
    got = s.collect()
    assert len(got) == 560 and imp.count() == 2
    right = [(r["score"] > 0.5) == r["y"] for r in got]
    assert np.mean(right) > 0.9


@pytest.mark.parametrize("small", [1 << 30, 60])
def test_forest_ranks_and_splits_large_nodes(spark, small):
    """The same quality where upper levels come from counts over all tasks; rows are dealt in any way."""
    from segmill.operators import forest, metrics

    _, df = table(spark, 420)
    got = {}
    for parts in (2, 5):
        s, imp = forest.forest_scores(df.repartition(parts), COLS, seeds=(0,), trees=25, small=small)
        got[parts] = sorted((r["segment_id"], r["score"]) for r in s.collect())
        shares = imp.first()["importance"]
        assert sum(shares) == pytest.approx(1.0) and shares[2] < shares[0]
    assert got[2] == got[5] and len(got[2]) == 420
    auc = metrics.auc(s.withColumn("model", F.lit("m")).filter("split = 'test' AND y IS NOT NULL"), ["model"]).first()["auc_roc"]
    assert auc > 0.6


def test_gini_split_is_the_best_of_all():
    from segmill.operators import forest

    rng = np.random.default_rng(5)
    for _ in range(30):
        x, y, w = rng.integers(0, 5, (20, 3)).astype(np.uint16), rng.integers(0, 2, 20), rng.integers(1, 4, 20).astype(float)
        gini = lambda k: 2 * (w[k] * y[k]).sum() * (w[k] * (1 - y[k])).sum() / w[k].sum() if k.any() else 0.0
        every = [(gini(np.ones(20, bool)) - gini(x[:, f] <= c) - gini(x[:, f] > c), f, c) for f in range(3) for c in range(4) if 0 < (x[:, f] <= c).sum() < 20]
        best = forest.gini_split(x, y, w, [0, 1, 2], 3)
        assert 2 * best[2] == pytest.approx(max(e[0] for e in every))


def test_draws_are_poisson():
    from segmill.operators import forest

    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 40_000)
    n = forest.draws(h, 7)
    assert abs(n.mean() - 1) < 0.03 and abs((n == 0).mean() - math.exp(-1)) < 0.02 and (forest.draws(h, 8) != n).any()


def test_levels_are_split_together_as_node_by_node():
    """The tree is that of gini_split at each node, in any order of the rows."""
    from segmill.operators import forest

    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (600, 5)).astype(np.uint16)
    x[rng.random(x.shape) < 0.1] = forest.BINS
    y, w, unit = (rng.random(600) < 0.2).astype(np.int32), rng.integers(1, 4, 600), (0.75, 2.5)
    t = forest.grow(x, y, w, 5, 0, math.inf, 2, unit)
    weight, todo, made = w * np.where(y == 1, unit[1], unit[0]), [(0, np.arange(600), 0)], 0
    while todo:
        node, rows, name = todo.pop()
        best = forest.gini_split(x[rows], y[rows], weight[rows], forest.tried(5, name, 5), 2) if len(set(y[rows])) > 1 else None
        assert t.value[node] == pytest.approx(np.average(y[rows], weights=weight[rows])) and (t.feature[node] < 0) == (best is None)
        if best is not None:
            made += 1
            assert (t.feature[node], t.bin[node]) == best[:2] and t.gain[node] == pytest.approx(best[2])
            left = x[rows, best[0]] <= best[1]
            todo += [(t.left[node], rows[left], 2 * name + 1), (t.left[node] + 1, rows[~left], 2 * name + 2)]
    by = rng.permutation(600)
    assert made > 50 and forest.grow(x[by], y[by], w[by], 5, 0, math.inf, 2, unit) == t
