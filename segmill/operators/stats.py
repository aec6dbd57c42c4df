"""Statistics (M6-M10, J12): rank correlation, histograms, paired tests, comparisons of models."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from segmill.operators.ranges import running_before
from segmill.session import ship


def unpivot(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Rows (keep..., feature, x)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def spearman(df: DataFrame, columns: list[str], label: str = "label", top: int = 30) -> DataFrame:
    """M6: |rho| of each feature with the label, 0 where a side is constant; the largest first.

    Rows are reduced to one per (feature, value) before ranking, and rho of mid-ranks is computed from
    these counts; ranks run over ranges of values, so no feature is gathered in one task.
    """
    x = unpivot(df, columns, [label]).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    g = x.groupBy("feature", "x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(label).cast("double").alias("p"))
    g = running_before(g, ["feature"], "x", "n", "_below").withColumn("r", F.col("_below") + (F.col("n") + 1.0) / 2.0)
    s = g.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("r") * F.col("n")).alias("sr"), F.sum(F.col("r") * F.col("r") * F.col("n")).alias("srr"), F.sum(F.col("r") * F.col("p")).alias("srp")
    )
    # The label's ranks are a linear function of the label, so rho is the correlation of r with it.
    n = F.col("n")
    cov = F.col("srp") / n - F.col("sr") / n * F.col("p") / n
    var_r = F.col("srr") / n - (F.col("sr") / n) * (F.col("sr") / n)
    var_y = F.col("p") / n * (1.0 - F.col("p") / n)
    rho = F.when((var_r > 1e-12) & (var_y > 0), F.abs(cov) / F.sqrt(var_r * var_y)).otherwise(F.lit(0.0))
    return s.select("feature", F.round(rho, 6).alias("rho")).orderBy(F.desc("rho"), "feature").limit(top)


def density(df: DataFrame, column: str, by: str, bins: int = 20) -> DataFrame:
    """M7: equal bins on [0, 1], the last one closed, by class; empty bins are left out."""
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    g = df.filter(F.col(column).between(0, 1)).groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(by))
    return g.withColumn("density", F.round(F.col("n") / (total * F.lit(1.0 / bins)), 6))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for k, num in enumerate((m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
            if k and abs(d * c - 1.0) < 1e-15:
                return h
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if math.isnan(t) or df < 1:
        return math.nan
    return 0.0 if math.isinf(t) else betainc(df / 2.0, 0.5, df / (df + t * t))


def t_p_udf():
    @pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_p_value(float(a), float(b)) for a, b in zip(t, n)], dtype="float64")

    return p


def size_of_effect(d: Column) -> Column:
    """M9's names."""
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def paired(values: DataFrame, by: list[str], with_p: bool = True, alpha: float = 0.05) -> DataFrame:
    """M8 and M9 over rows (by, seed, a, b): t is that of a - b, d that of b - a.

    Without variance t is infinite (0 for no difference at all) and p 0, and d is 0; for less than two
    pairs both are null.
    """
    diff = F.col("a") - F.col("b")
    g = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(diff).alias("_m"), F.stddev_samp(diff).alias("_s")
    )
    zero = F.col("_s") < 1e-15
    t = F.when(F.col("n") < 2, F.lit(None)).when(zero, F.when(F.abs("_m") < 1e-15, F.lit(0.0)).otherwise(F.signum("_m") * F.lit(float("inf"))))
    t = t.otherwise(F.try_divide(F.col("_m"), F.col("_s") / F.sqrt(F.col("n").cast("double"))))
    d = F.when(F.col("n") < 2, F.lit(None)).when(zero, F.lit(0.0)).otherwise(F.try_divide(-F.col("_m"), F.col("_s")))
    better = F.when(F.col("_m") < 0, "b").when(F.col("_m") > 0, "a").otherwise("tie")
    out = g.select(*by, "n", "mean_a", "mean_b", t.alias("t"), d.alias("cohens_d"), better.alias("direction")).withColumn("effect", size_of_effect(F.col("cohens_d")))
    if not with_p:
        return out
    ship(values.sparkSession)
    p = F.when(F.col("t").isNotNull(), t_p_udf()(F.coalesce("t", F.lit(0.0)), (F.col("n") - 1).cast("double")))
    return out.withColumn("p_value", p).withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def t_test(a: list[float], b: list[float]) -> dict:
    """The same for two lists on the driver; lists of unequal length are an error."""
    if len(a) != len(b):
        raise ValueError("paired samples differ in length")
    n = len(a)
    if n < 2:
        return {"n": n, "t": None, "p_value": None, "cohens_d": None, "significant": False}
    d = [x - y for x, y in zip(a, b)]
    m = sum(d) / n
    s = math.sqrt(sum((x - m) ** 2 for x in d) / (n - 1))
    if s < 1e-15:
        t = 0.0 if abs(m) < 1e-15 else math.copysign(math.inf, m)
        p, effect = (1.0 if t == 0.0 else 0.0), 0.0
    else:
        t, effect = m / (s / math.sqrt(n)), -m / s
        p = t_p_value(t, n - 1)
    return {"n": n, "t": t, "p_value": p, "cohens_d": effect, "significant": p < 0.05, "direction": "b" if m < 0 else "a" if m > 0 else "tie"}


def compare_models(metrics: DataFrame, metric: str = "auc_roc", with_p: bool = True) -> DataFrame:
    """Each pair of models with equally many seeds, at least two, paired by seed."""
    m = metrics.filter(F.col("metric") == metric)
    sizes = m.groupBy("model").agg(F.count(F.lit(1)).alias("n_seeds"))
    m = m.join(sizes, "model").filter("n_seeds > 1")
    a = m.select(F.col("model").alias("model_a"), "seed", F.col("value").alias("a"), "n_seeds")
    b = m.select(F.col("model").alias("model_b"), "seed", F.col("value").alias("b"), "n_seeds")
    return paired(a.join(b, ["seed", "n_seeds"]).filter("model_a < model_b"), ["model_a", "model_b"], with_p)
