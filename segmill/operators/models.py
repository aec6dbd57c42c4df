"""Baselines and learners (L4, L5, L8, M11-M14). Networks of other kinds enter as tables of scores."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill import schema
from segmill.functions.scalar import rule_score
from segmill.operators import boosting, forest, metrics, splits, stats
from segmill.session import spread

SCORE_COLUMNS = ["model", "seed", "split", "video_id", "segment_id", "y", "score"]


def _scores(df: DataFrame, model: str, seed: int, score) -> DataFrame:
    return df.select(
        F.lit(model).alias("model"), F.lit(seed).alias("seed"), "split", "video_id", "segment_id", F.col("label").cast("int").alias("y"), score.cast("float").alias("score")
    )


def rule_based(df: DataFrame, weights: dict[str, float] = schema.RULE_WEIGHTS, strict: bool = True) -> DataFrame:
    """Scores by the fixed weights; with `strict` all weighted columns must be there."""
    missing = [c for c in weights if c not in df.columns]
    if strict and missing:
        raise ValueError(f"features missing: {missing}")
    return _scores(df, "rule_based", 0, rule_score(weights, df.columns))


#: Rows of all trials that one task makes.
TRIAL_ROWS = 1 << 20


def random_baseline(df: DataFrame, trials: int = 100) -> DataFrame:
    """A uniform score for each trial, which the trial and the row's id determine. Rows are dealt out
    before they are copied, over as many tasks as what comes of them needs."""
    keys = ("video_id", "segment_id")
    df = spread(df.select(*keys, "split", "label"), *keys, parts=math.ceil(df.count() * trials / TRIAL_ROWS))
    t = df.withColumn("_trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    u = F.pmod(F.xxhash64("_trial", "segment_id"), F.lit(1 << 24)) / float(1 << 24)
    return t.select(
        F.lit("random").alias("model"), F.col("_trial").alias("seed"), "split", "video_id", "segment_id", F.col("label").cast("int").alias("y"), u.cast("float").alias("score")
    )


def class_weight(df: DataFrame) -> float:
    """Negatives over positives, at least one positive assumed."""
    r = df.agg(F.count_if(F.col("label") == 0).alias("n"), F.count_if(F.col("label") == 1).alias("p")).first()
    return r["n"] / max(r["p"], 1)


def random_forest(df: DataFrame, columns: list[str], seeds: tuple[int, ...] = (0, 1, 2, 3, 4), trees: int = 100, depth: int | None = None, name: str = "random_forest"):
    """L4: (scores of all splits, importances) for each seed; balanced weights, grown to pure leaves."""
    s, importance = forest.forest_scores(df, columns, seeds, trees, depth)
    return s.select(F.lit(name).alias("model"), "seed", "split", "video_id", "segment_id", "y", "score"), importance


def boosted_runs(
    df: DataFrame, runs: dict[str, list[str]], where: dict[str, Column] | None = None, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), params: boosting.Params = boosting.Params()
) -> tuple[DataFrame, boosting.Study]:
    """L5 for several sets of columns, or parts of the training rows, in the same jobs. Growing draws
    nothing at random, so every seed has the same scores."""
    study = boosting.boost(df, runs, where, params)
    s = study.scores().withColumn("seed", F.explode(F.array(*[F.lit(k) for k in seeds])))
    return s.select("model", "seed", "split", "video_id", "segment_id", "y", "score"), study


def boosted_trees(
    df: DataFrame, columns: list[str], seeds: tuple[int, ...] = (0, 1, 2, 3, 4), rounds: int = 200, depth: int = 6, rate: float = 0.1, patience: int = 20, name: str = "boosted"
) -> tuple[DataFrame, DataFrame]:
    """Boosting that stops by the area under precision by recall on the validation split; positives weigh
    negatives / positives. (scores of all splits, importances) for each seed."""
    scores, study = boosted_runs(df, {name: columns}, None, seeds, boosting.Params(rounds, depth, rate, patience))
    own = study.importance(study.models[0])
    return scores, df.sparkSession.createDataFrame([(s, own) for s in seeds], "seed int, importance array<double>")


Learner = Callable[..., tuple[DataFrame, DataFrame]]


def _all_runs(df: DataFrame, runs: dict[str, list[str]], where: dict[str, Column], learner: Learner, how: dict) -> DataFrame:
    """Scores of every run: boosting grows them together, other learners one after the other."""
    if learner is boosted_trees:
        settings = {k: how[k] for k in boosting.Params._fields if k in how}
        return boosted_runs(df, runs, where, params=boosting.Params(**settings), **{k: v for k, v in how.items() if k not in settings})[0]
    scores = None
    for name, columns in runs.items():
        some = df.filter((F.col("split") != "train") | where[name]) if name in where else df
        one, _ = learner(some, columns, name=name, **how)
        scores = one if scores is None else scores.union(one)
    return scores


def ablation(df: DataFrame, groups: dict[str, list[str]], learner: Learner, **how) -> DataFrame:
    """Without each group and with it alone, against all features: mean AUC, its difference and the
    paired test. The scores of all runs are evaluated in one pass."""
    every = [c for g in groups.values() for c in g]
    runs = {"baseline": every}
    runs |= {f"without:{k}": [c for c in every if c not in g] for k, g in groups.items() if len(groups) > 1}
    runs |= {f"only:{k}": g for k, g in groups.items()}
    scores = _all_runs(df, runs, {}, learner, how)
    auc = metrics.auc(scores.filter("split = 'test'"), ["model", "seed"]).select("model", "seed", F.col("auc_roc").alias("value"))
    base = auc.filter("model = 'baseline'").select("seed", F.col("value").alias("a"))
    pairs = auc.filter("model <> 'baseline'").join(base, "seed").select("model", "seed", "a", F.col("value").alias("b"))
    t = stats.paired(pairs, ["model"])
    return t.select(
        F.substring_index("model", ":", 1).alias("kind"), F.substring_index("model", ":", -1).alias("category"), F.col("mean_b").alias("auc"), (F.col("mean_b") - F.col("mean_a")).alias("delta_auc"), "t", "p_value", "cohens_d", "significant"
    )


def learning_curve(df: DataFrame, columns: list[str], fractions: tuple[float, ...], learner: Learner, **how) -> DataFrame:
    """Test AUC by the share of training groups."""
    where = {str(f): splits.in_fraction(f) for f in fractions}
    scores = _all_runs(df, {str(f): columns for f in fractions}, where, learner, how)
    n = df.filter("split = 'train'").agg(*[F.coalesce(F.sum(F.when(w, F.col("label"))), F.lit(0)).cast("int").alias(f) for f, w in where.items()])
    n = n.select(F.explode(F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.col(f"`{f}`").alias("n_positives")) for f in where])).alias("x")).select("x.*")
    auc = metrics.auc(scores.filter("split = 'test'"), ["model", "seed"]).groupBy(F.col("model").cast("double").alias("fraction"))
    each = auc.agg(F.avg("auc_roc").alias("auc"), F.coalesce(F.stddev_samp("auc_roc"), F.lit(0.0)).alias("auc_std"))
    return each.join(n, "fraction").select(F.lit(how.get("name", learner.__name__)).alias("model"), "auc", "auc_std", "fraction", "n_positives")
