"""Ranking metrics (M1-M5), seed aggregates (A14, A15) and top-k.

All models, seeds and splits are evaluated at once: `by` names the columns that tell them apart.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segmill.operators.ranges import running_before
from segmill.session import materialize

K_VALUES = (3, 5, 10)


def ranked(scores: DataFrame, by: list[str], video: str = "video_id", ident: str = "segment_id") -> DataFrame:
    """With the rank within the video by score; equal scores by id."""
    w = W.partitionBy(*by, video).orderBy(F.desc("score"), ident)
    return scores.withColumn("rank", F.row_number().over(w))


def _discounts(n: int) -> list[float]:
    """Sums of the discounts of the first 0, 1, ... n ranks."""
    return [0.0, *accumulate(1.0 / math.log2(r + 1) for r in range(1, n + 1))]


def per_video(scores: DataFrame, by: list[str], ks: tuple[int, ...] = K_VALUES, video: str = "video_id", ident: str = "segment_id") -> DataFrame:
    """M3 and M4 for each video, of labels 0 or 1, without gathering a video.

    k is at most the number of segments. In NDCG equal scores share their mean gain, the ideal order
    ignores ties, and a video of one segment has 0. Rows are counted by score first; of a video only the
    first max(ks) scores, and for the hits its first max(ks) rows, are ever ranked, and both limits hold
    within tasks before anything is shuffled by video.
    """
    keys, top = [*by, video], max(ks)
    sums = F.array(*map(F.lit, _discounts(top)))
    upto = lambda n, k: F.element_at(sums, F.least(n, F.lit(k)).cast("int") + 1)
    groups = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("p"))
    first = groups.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score")))).filter(F.col("_rank") <= top)
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("_rank").rowsBetween(W.unboundedPreceding, -1))
    first = first.withColumn("_before", F.coalesce(before, F.lit(0)))
    gain = lambda k: F.col("p") / F.col("n") * (upto(F.col("_before") + F.col("n"), k) - upto(F.col("_before"), k))
    rows = ranked(scores, by, video, ident).filter(F.col("rank") <= top)
    hit = lambda k: F.when(F.col("rank") <= k, F.col("y")).otherwise(0).cast("double")
    # What the three say of a video meets in one sum.
    names = ["n_segments", "n_positives", *[f"{c}{k}" for k in ks for c in ("_dcg", "_hit")]]
    pieces = [
        groups.select(*keys, F.col("n").alias("n_segments"), F.col("p").alias("n_positives")),
        first.select(*keys, *[gain(k).alias(f"_dcg{k}") for k in ks]),
        rows.select(*keys, *[hit(k).alias(f"_hit{k}") for k in ks]),
    ]
    g = reduce(lambda a, b: a.unionByName(b, True), pieces).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    out: list[Column] = []
    for k in ks:
        ideal = upto(F.col("n_positives"), k)
        out += [
            (F.col(f"_hit{k}") / F.least(F.lit(k), F.col("n_segments"))).alias(f"precision_at_{k}"),
            F.when(F.col("n_positives") > 0, F.col(f"_hit{k}") / F.col("n_positives")).otherwise(F.lit(0.0)).alias(f"recall_at_{k}"),
            F.when((F.col("n_segments") > 1) & (F.col("n_positives") > 0), F.col(f"_dcg{k}") / ideal).otherwise(F.lit(0.0)).alias(f"ndcg_at_{k}"),
        ]
    return g.select(*keys, "n_segments", "n_positives", *out)


def auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """M1: share of pairs in the right order, ties counting half; NaN for one class only. Rows are first
    reduced to one per distinct score, and the sums below a score run over ranges of scores."""
    g = scores.groupBy(*by, "score").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n"))
    g = running_before(g, by, "score", "n", "_below")
    g = g.withColumn("_won", F.col("p") * (F.col("_below") + F.lit(0.5) * F.col("n")))
    pairs = F.sum("p") * F.sum("n")
    return g.groupBy(*by).agg(F.when(pairs > 0, F.sum("_won") / pairs).otherwise(F.lit(float("nan"))).alias("auc_roc"))


def f1(scores: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """M2."""
    hit = F.col("score") >= F.lit(threshold)
    tp, fp, fn = F.count_if(hit & (F.col("y") == 1)), F.count_if(hit & (F.col("y") == 0)), F.count_if(~hit & (F.col("y") == 1))
    bottom = 2 * tp + fp + fn
    return scores.groupBy(*by).agg(F.when(bottom > 0, 2.0 * tp / bottom).otherwise(F.lit(0.0)).alias("f1"))


def evaluate(scores: DataFrame, by: list[str], ks: tuple[int, ...] = K_VALUES, video: str = "video_id", ident: str = "segment_id") -> DataFrame:
    """M5: one row per `by`. Videos without a positive count as videos but not in the means. The scores
    are written once, as three branches read them."""
    scores = materialize(scores.select(*by, video, ident, "y", "score"))
    v = per_video(scores, by, ks, video, ident)
    ok = F.col("n_positives") > 0
    names = [f"{m}_at_{k}" for k in ks for m in ("precision", "recall", "ndcg")]
    g = v.groupBy(*by).agg(
        F.sum("n_segments").alias("n_segments"), F.sum("n_positives").alias("n_positives"), F.count(F.lit(1)).alias("n_videos"), F.count_if(ok).alias("n_ranked_videos"),
        *[F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)).alias(c) for c in names],
    )
    return reduce(lambda a, b: a.join(b, by), [g, auc(scores, by), f1(scores, by)])


def long_format(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, value) of all metrics."""
    names = [c for c in evaluated.columns if c not in by]
    return evaluated.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select(*by, "x.*")


def report_order(df: DataFrame, value: str, ident: str, best_first: bool = True) -> DataFrame:
    """T4: a report's rows, the best (or for changes, the worst) first, nulls last; equal ones by name."""
    v = F.col(value)
    return df.orderBy(v.desc_nulls_last() if best_first else v.asc_nulls_last(), ident)


def seed_aggregate(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per model and metric the mean, sample deviation (0 for one value), number and values by seed."""
    by = by or ["model", "metric"]
    values = F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda s: s["value"])
    return metrics.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"), values.alias("values")
    )


def importance(df: DataFrame, names: list[str], top: int = 5) -> DataFrame:
    """Mean importance over seeds, the largest first, from rows (seed, importance array)."""
    each = df.select("seed", F.posexplode("importance").alias("i", "value"))
    named = each.withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1))
    return named.groupBy("feature").agg(F.avg("value").alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)
