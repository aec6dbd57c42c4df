"""Clipping, train-only statistics, z-scores and PCA."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill import schema
from segmill.functions.scalar import clip_unit


def clip_columns(df: DataFrame, columns: list[str] = schema.UNIT_COLUMNS) -> DataFrame:
    """P10."""
    return df.withColumns({c: clip_unit(F.col(c)) for c in columns if c in df.columns})


def clip_counts(df: DataFrame, columns: list[str] = schema.UNIT_COLUMNS) -> DataFrame:
    """How many values P10 changes, by column."""
    have = [c for c in columns if c in df.columns]
    one = df.agg(*[F.count_if(F.col(c) < 0).alias(f"u_{c}") for c in have], *[F.count_if((F.col(c) > 1) & ~F.isnan(F.col(c))).alias(f"o_{c}") for c in have])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"u_{c}").alias("under"), F.col(f"o_{c}").alias("over")) for c in have])).alias("x")).select("x.*")


def train_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std) of the training rows, population deviation, NaN left out. One pass: all
    features are summed in the same partial aggregate and turned into rows afterwards."""
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    one = df.filter("split = 'train'").agg(*[F.avg(v).alias(f"m_{c}") for c, v in clean.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in clean.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def zscore(df: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std by the training rows' statistics; where std is 0 the column is 0 in
    all splits. The statistics are one row, joined by broadcast."""
    stats = train_stats(df, columns) if stats is None else stats
    wide = stats.groupBy().pivot("feature", columns).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    wide = wide.select(*[F.col(f"{c}_mean").alias(f"_m_{c}") for c in columns], *[F.col(f"{c}_std").alias(f"_s_{c}") for c in columns])
    x = df.join(F.broadcast(wide), F.lit(True), "left")
    scaled = {c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return x.withColumns(scaled).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def normalise(df: DataFrame) -> DataFrame:
    """The whole step on a feature table with splits: clip, then scale all but the binary columns."""
    columns = [c for c in schema.FEATURE_COLUMNS if c in df.columns and c not in schema.BINARY_COLUMNS]
    return zscore(clip_columns(df), columns)


def nan_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """A10: cells that are null or NaN, and their share of all, in one pass."""
    bad = F.lit(0)
    for c in columns:
        bad = bad + F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0)
    cells = F.count(F.lit(1)) * len(columns)
    return df.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("n_missing"), cells.alias("n_cells"), F.round(100.0 * F.coalesce(F.sum(bad), F.lit(0)) / F.greatest(cells, F.lit(1)), 6).alias("pct"))


def fit_pca(train: DataFrame, k: int, vector: str = "embedding"):
    """L2: centring and projection, fitted on the training rows that have a vector."""
    x = train.filter(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(x)
    return centre, PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(x))


def project(df: DataFrame, model, vector: str = "embedding", out: str = "pca") -> DataFrame:
    """L2: all rows; zeros where there is no vector."""
    centre, pca = model
    k = pca.getK()
    size = len(centre.mean)
    some = df.withColumn("_has", F.col(vector).isNotNull()).withColumn(
        "_v", array_to_vector(F.coalesce(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), size)))
    )
    done = pca.transform(centre.transform(some))
    return done.withColumn(out, F.when(F.col("_has"), vector_to_array("_p")).otherwise(F.array_repeat(F.lit(0.0), k))).drop("_has", "_v", "_c", "_p")


def pca_columns(df: DataFrame, model, vector: str = "embedding") -> DataFrame:
    """The projection as columns clip_pca_00 and so on."""
    x = project(df, model, vector, "_pca")
    k = model[1].getK()
    return x.withColumns({f"clip_pca_{i:02d}": F.col("_pca")[i] for i in range(k)}).drop("_pca")
