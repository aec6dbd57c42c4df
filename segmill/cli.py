"""Command line over the library (C6): python -m segmill.cli <command> ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill import schema
from segmill.operators import captions, discovery, engagement, metrics, models, normalise, segments, splits, stats, validation
from segmill.plans import pipelines
from segmill.session import build_session
from segmill.sources import readers, writers


def _save(df: DataFrame, out: str | None) -> None:
    if out:
        df.write.mode("overwrite").parquet(out)
    else:
        print(writers.markdown(df))


def discover(spark: SparkSession, a: argparse.Namespace) -> None:
    """Channels that pass the filters, with their bracket."""
    channels = readers.csv(spark, a.input, schema.SCHEMAS["channels"])
    from segmill.functions.scalar import bracket

    x = discovery.channel_filter(channels).withColumn("subscriber_bracket", bracket(F.col("subscribers")))
    _save(discovery.creator_ids(x), a.out)


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Caption files as text, entries and chunks."""
    _save(captions.parse_captions(readers.captions(spark, a.input)), a.out)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    """All creators' feature files as one table, checked."""
    x = readers.features(spark, a.input)
    normalise.nan_rate(x, schema.FEATURE_COLUMNS).show()
    _save(x, a.out)


def verify(spark: SparkSession, a: argparse.Namespace) -> None:
    """Headers and null shares by file, and whether a file passes."""
    _save(readers.verify_files(spark, a.input, schema.SCHEMAS["features"]), a.out)


def relabel(spark: SparkSession, a: argparse.Namespace) -> None:
    """Labels of the segments from pairs at the given thresholds; the shares of viral pairs before and after."""
    old = readers.pairs(spark, a.pairs)
    pairs = engagement.relabel_pairs(old, a.eng_mult, a.vpd_mult)
    engagement.viral_split(old).union(engagement.viral_split(pairs)).show()
    _save(engagement.relabel(spark.read.parquet(a.input), pairs).select(*schema.OUTPUT_COLUMNS), a.out)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    x = spark.read.parquet(a.input)
    x = splits.exact_group_split(x, seed=a.seed) if a.exact else splits.group_split(x)
    splits.counts(splits.check_no_leak(x)).show()
    _save(x, a.out)


def pca(spark: SparkSession, a: argparse.Namespace) -> None:
    x = spark.read.parquet(a.input).drop(*[f"clip_pca_{i:02d}" for i in range(schema.PCA_DIMS)])
    x = x.join(readers.embeddings(spark, a.embeddings), ["video_id", "segment_index"], "left")
    _save(normalise.pca_columns(x, normalise.fit_pca(x.filter("split = 'train'"), schema.PCA_DIMS)).drop("embedding"), a.out)


def scale(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.matrix(normalise.normalise(spark.read.parquet(a.input)), a.out)


def post(spark: SparkSession, a: argparse.Namespace) -> None:
    """Merge, relabel, split, PCA and normalise in one plan."""
    e = readers.embeddings(spark, a.embeddings) if a.embeddings else None
    writers.matrix(pipelines.post_extraction(readers.features(spark, a.input), readers.pairs(spark, a.pairs), e, thresholds=(a.eng_mult, a.vpd_mult)), a.out)


def run_model(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores of a baseline or learner, and their metrics."""
    x = spark.read.parquet(a.input)
    columns = [c for c in schema.FEATURE_COLUMNS if c in x.columns]
    kinds = {
        "random": lambda: models.random_baseline(x.filter("split = 'test'")),
        "rules": lambda: models.rule_based(x.filter("split = 'test'"), strict=False),
        "forest": lambda: models.random_forest(x, columns)[0].filter("split = 'test'"),
        "boosted": lambda: models.boosted_trees(x, columns)[0].filter("split = 'test'"),
    }
    scores = kinds[a.model]()
    by = ["model", "seed"]
    _save(metrics.seed_aggregate(metrics.long_format(metrics.evaluate(scores, by), by)).drop("values"), a.out)


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Paired tests of models from a table (model, seed, metric, value)."""
    _save(stats.compare_models(spark.read.parquet(a.input), a.metric), a.out)


def ablate(spark: SparkSession, a: argparse.Namespace) -> None:
    x = spark.read.parquet(a.input)
    groups = {k: [c for c in v if c in x.columns] for k, v in schema.GROUPS.items()}
    _save(models.ablation(x, {k: v for k, v in groups.items() if v}, models.boosted_trees), a.out)


def status(spark: SparkSession, a: argparse.Namespace) -> None:
    """Roll-up of progress markers."""
    markers = spark.read.schema(schema.SCHEMAS["progress"]).option("multiLine", True).json(a.input)
    _save(validation.progress_summary(markers), a.out)


def assign(spark: SparkSession, a: argparse.Namespace) -> None:
    creators = spark.read.parquet(a.input)
    _save(discovery.round_robin(creators, a.machines), a.out)


def text(spark: SparkSession, a: argparse.Namespace) -> None:
    """Text features of a table with text, duration and words."""
    x = spark.read.parquet(a.input)
    _save(segments.text_features(x, words="words" if "words" in x.columns else None), a.out)


COMMANDS = {
    "discover": discover, "captions": parse, "text": text, "assign": assign, "status": status, "merge": merge, "verify": verify, "relabel": relabel,
    "split": split, "pca": pca, "normalise": scale, "post": post, "model": run_model, "compare": compare, "ablation": ablate,
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="segmill", description=__doc__)
    p.add_argument("command", choices=list(COMMANDS))
    p.add_argument("input", help="a path or glob that Spark reads")
    p.add_argument("--out", help="where to write; without it a small result is printed")
    p.add_argument("--pairs")
    p.add_argument("--embeddings")
    p.add_argument("--model", choices=["random", "rules", "forest", "boosted"], default="rules")
    p.add_argument("--eng-mult", type=float, default=schema.ENGAGEMENT_MULTIPLIER, help="a pair is viral above so many medians of the engagement rate")
    p.add_argument("--vpd-mult", type=float, default=schema.VIEWS_MULTIPLIER, help="or above so many medians of the views per day")
    p.add_argument("--metric", default="auc_roc")
    p.add_argument("--machines", type=int, default=1)
    p.add_argument("--exact", action="store_true", help="exact numbers of groups instead of the hash split")
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    COMMANDS[a.command](SparkSession.getActiveSession() or build_session(), a)


if __name__ == "__main__":
    main()
