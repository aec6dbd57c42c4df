"""Plans made of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from segmill import schema
from segmill.operators import engagement, metrics, models, normalise, segments, splits
from segmill.plans import tables

SLICE_FEATURES = ["hook_word_ratio", "words_per_second", "position_ratio"]


def slice_features(segs: DataFrame) -> DataFrame:
    """Text and structural features with the split; features that need external extractors aren't there."""
    return splits.group_split(segments.structural_features(segments.text_features(segs)))


def rank_by_rules(segs: DataFrame) -> DataFrame:
    """Scores of the rule-based model after train-only scaling. Weights of features that only external
    extractors give count as 0."""
    scaled = normalise.zscore(slice_features(segs), SLICE_FEATURES)
    return models.rule_based(scaled, strict=False)


def rank_metrics(spark, sf: str) -> DataFrame:
    """The flagship: ranking metrics of the rule-based score over all splits of the document segments."""
    scores = rank_by_rules(tables.doc_segments(spark, sf))
    return metrics.evaluate(scores, ["model"])


def post_extraction(
    features: DataFrame, pairs: DataFrame, embeddings: DataFrame | None = None, k: int = schema.PCA_DIMS,
    thresholds: tuple[float, float] | None = None,
) -> DataFrame:
    """Relabel, split, fill PCA columns and normalise: one lazy plan but for the fits on training rows. With
    thresholds (of engagement and of views) the pairs' labels are recomputed, else the stored ones count."""
    x = splits.group_split(engagement.relabel(features, engagement.relabel_pairs(pairs, *thresholds) if thresholds else pairs))
    if embeddings is not None:
        x = x.drop(*[f"clip_pca_{i:02d}" for i in range(k)]).join(embeddings, ["video_id", "segment_index"], "left")
        x = normalise.pca_columns(x, normalise.fit_pca(x.filter("split = 'train'"), k)).drop("embedding")
    return normalise.normalise(x)
