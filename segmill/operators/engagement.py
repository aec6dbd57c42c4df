"""Engagement of shorts, creator baselines and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segmill import schema
from segmill.functions import scalar


def engagement(videos: DataFrame, as_of: Column, disabled: Column | None = None) -> DataFrame:
    """Rates of shorts; videos without a date go."""
    off = F.lit(False) if disabled is None else disabled
    live = scalar.days_live(F.col("published_at"), as_of)
    return (
        videos.filter(F.col("published_at").isNotNull())
        .withColumn("days_since_published", live)
        .withColumn("views_per_day", scalar.views_per_day(F.col("views"), F.col("days_since_published")))
        .withColumn("engagement_rate", scalar.engagement_rate(F.col("likes"), F.col("comments"), F.col("views"), off))
        .withColumn("engagement_formula", F.when(off, "likes/views").otherwise("standard"))
        .withColumn("excluded_reason", F.when(scalar.too_recent(F.col("published_at"), as_of), "too_recent").otherwise(""))
    )


def baselines(shorts: DataFrame) -> DataFrame:
    """A1: one row per creator with an eligible short; medians interpolate."""
    ok = F.col("excluded_reason") == ""
    of = lambda c: F.when(ok, F.col(c))
    whole = lambda c: c.cast("bigint")  # noqa: E731  cuts off the fraction

    def in_units(kind: str, column: str, units: float) -> Column:
        """The rates are multiples of 1 / units; whole numbers make the result exact, halves go up."""
        n = F.round(of(column) * F.lit(units)).cast("bigint")
        return F.floor((F.median(n) if kind == "median" else F.avg(n)) + F.lit(0.5)) / F.lit(units)

    out = shorts.groupBy("creator_id").agg(
        F.count_if(ok).cast("int").alias("total_shorts_analysed"),
        F.count_if(~ok).cast("int").alias("shorts_excluded_too_recent"),
        in_units("median", "engagement_rate", 1e6).alias("median_engagement_rate"),
        in_units("avg", "engagement_rate", 1e6).alias("mean_engagement_rate"),
        whole(F.median(of("views"))).alias("median_views"),
        whole(F.avg(of("views"))).alias("mean_views"),
        whole(F.coalesce(F.stddev_samp(of("views")), F.lit(0.0))).alias("std_views"),
        in_units("median", "views_per_day", 10.0).alias("median_views_per_day"),
        in_units("avg", "views_per_day", 10.0).alias("mean_views_per_day"),
        whole(F.median(of("likes"))).alias("median_likes"),
        whole(F.median(of("comments"))).alias("median_comments"),
        F.bool_or(F.col("engagement_formula") == "likes/views").alias("comments_disabled"),
    )
    return out.filter("total_shorts_analysed > 0").withColumn(
        "engagement_formula_used", F.when(F.col("comments_disabled"), "likes/views").otherwise("standard")
    )


def last_row(df: DataFrame, key: str, position: str) -> DataFrame:
    """The row of each key that comes last, as where a later one replaces an earlier one."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(position)).alias("x")).select(key, "x.*")


def label_pairs(
    pairs: DataFrame, shorts: DataFrame, base: DataFrame, engagement_times: float = schema.ENGAGEMENT_MULTIPLIER, views_times: float = schema.VIEWS_MULTIPLIER
) -> DataFrame:
    """Pairs with the engagement of their short and the label; pairs whose short isn't known
    go. `shorts` has one row per video_id; baselines are few columns per creator."""
    s = shorts.select(
        F.col("video_id").alias("short_id"),
        F.col("creator_id"),
        F.col("views").alias("short_views"),
        F.col("likes").alias("short_likes"),
        F.col("comments").alias("short_comments"),
        F.round("engagement_rate", 6).alias("short_engagement_rate"),
        F.round("views_per_day", 1).alias("short_views_per_day"),
    )
    b = base.select(
        "creator_id",
        F.col("median_engagement_rate").alias("creator_median_engagement_rate"),
        F.col("median_views_per_day").alias("creator_median_views_per_day"),
    )
    joined = pairs.drop("creator_id").join(s, "short_id").join(b, "creator_id", "left")
    return relabel_pairs(joined, engagement_times, views_times)


def relabel(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """A segment is positive if any of its pairs is viral. Pairs are reduced to one row per segment
    before the join; running it again changes nothing."""
    hit = pairs.groupBy(F.col("long_id").alias("video_id"), F.col("matched_segment_index").alias("segment_index")).agg(F.max("label").alias("_new"))
    return segments.drop("label").join(hit, ["video_id", "segment_index"], "left").withColumn("label", F.coalesce("_new", F.lit(0))).drop("_new")


def relabel_pairs(pairs: DataFrame, engagement_times: float = schema.ENGAGEMENT_MULTIPLIER, views_times: float = schema.VIEWS_MULTIPLIER) -> DataFrame:
    """F21 for stored pairs: flags and label at these thresholds, from the rates and medians they carry."""
    er = scalar.exceeds(F.col("short_engagement_rate"), F.col("creator_median_engagement_rate"), engagement_times)
    vpd = scalar.exceeds(F.col("short_views_per_day"), F.col("creator_median_views_per_day"), views_times)
    return pairs.withColumns({"meets_engagement_threshold": er, "meets_views_threshold": vpd, "label": F.when(er | vpd, 1).otherwise(0)})


def viral_split(pairs: DataFrame, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """The share of viral pairs, and whether it lies outside the usual range."""
    pct = F.when(F.count(F.lit(1)) > 0, 100.0 * F.sum("label") / F.count(F.lit(1))).otherwise(F.lit(0.0))
    out = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_viral"), F.round(pct, 4).alias("viral_pct"))
    return out.withColumn("unusual", ~F.col("viral_pct").between(low, high))


def by_category(segments: DataFrame) -> DataFrame:
    """A3."""
    return segments.groupBy("category").agg(
        F.sum("label").alias("positives"), F.count(F.lit(1)).alias("n"), F.round(100.0 * F.sum("label") / F.count(F.lit(1)), 4).alias("pct")
    )


def best_pair(pairs: DataFrame, position: str = "pos") -> DataFrame:
    """Per segment of a long the pair with the highest score, the first of equal ones."""
    cols = [c for c in pairs.columns if c not in ("long_id", "matched_segment_index")]
    top = F.max_by(F.struct(*cols), F.struct(F.col("match_score"), -F.col(position)))
    return pairs.groupBy("long_id", "matched_segment_index").agg(top.alias("x")).select("long_id", "matched_segment_index", "x.*")


def segments_of(videos: DataFrame, seconds: int = schema.SEGMENT_SECONDS) -> DataFrame:
    """F16: rows of segments from (video_id, duration, ...); no rows without a duration."""
    n = F.ceil(F.col("duration") / seconds).cast("int")
    cut = videos.filter(F.col("duration") > 0).withColumn("segment_index", F.explode(F.sequence(F.lit(0), n - 1)))
    start = (F.col("segment_index") * seconds).cast("double")
    return (
        cut.withColumnRenamed("duration", "video_duration")
        .withColumn("start_time", start)
        .withColumn("end_time", F.least(start + seconds, F.col("video_duration").cast("double")))
        .withColumn("duration", F.col("end_time") - F.col("start_time"))
    )


def label_segments(segments: DataFrame, pairs: DataFrame, transcripts: DataFrame | None = None, position: str = "pos") -> DataFrame:
    """Segments with the best pair's label, and the columns of the labelled table."""
    b = best_pair(pairs, position).select(
        F.col("long_id").alias("video_id"),
        F.col("matched_segment_index").alias("segment_index"),
        F.col("short_id").alias("matched_short_id"),
        "match_score",
        F.col("label").alias("_label"),
        F.col("short_views").alias("matched_short_views"),
        F.col("short_engagement_rate").alias("matched_short_engagement_rate"),
    )
    x = segments.join(b, ["video_id", "segment_index"], "left")
    if transcripts is not None:
        x = x.join(transcripts.select("video_id", "segment_index", F.col("text").alias("transcript_text")), ["video_id", "segment_index"], "left")
    else:
        x = x.withColumn("transcript_text", F.lit(None).cast("string"))
    viral = F.coalesce(F.col("_label"), F.lit(0)) == 1
    v, i = F.col("video_id"), F.col("segment_index")
    flags = scalar.quarter_flags(F.col("start_time"), F.col("video_duration"))
    return x.select(
        scalar.segment_id(v, i).alias("segment_id"), "video_id", "creator_id", "category", "segment_index",
        *[F.round(c, 1).alias(c) for c in ("start_time", "end_time", "duration", "video_duration")],
        *[c.alias(k) for k, c in flags.items()],
        scalar.segment_path(v, i, "audio", "wav").alias("audio_path"),
        scalar.segment_path(v, i, "video", "mp4").alias("video_path"),
        scalar.segment_path(v, i, "thumbnails", "jpg").alias("thumbnail_path"),
        F.coalesce("transcript_text", F.lit("")).alias("transcript_text"),
        F.when(viral, 1).otherwise(0).alias("label"),
        F.when(viral, F.col("matched_short_engagement_rate")).alias("virality_score_raw"),
        F.coalesce("matched_short_id", F.lit("")).alias("matched_short_id"),
        F.when(viral, scalar.confidence(F.col("match_score"))).when(F.col("_label").isNotNull(), "high").otherwise("").alias("match_confidence"),
        "matched_short_views", "matched_short_engagement_rate",
    )


def master_index(segments: DataFrame) -> DataFrame:
    """S3's index: derived paths of each segment; paths of the short only where there is one."""
    matched = F.col("matched_short_id").isNotNull() & (F.col("matched_short_id") != "")
    v, i = F.col("video_id"), F.col("segment_index")
    short = lambda kind, suffix: F.when(matched, F.format_string(f"raw/shorts/{kind}/%s.{suffix}", F.col("matched_short_id"))).otherwise("")
    return segments.select(
        "segment_id", "video_id", "creator_id", "category", "segment_index", "label", "matched_short_id",
        scalar.segment_path(v, i, "audio", "wav").alias("audio_path"),
        scalar.segment_path(v, i, "video", "mp4").alias("video_path"),
        scalar.segment_path(v, i, "thumbnails", "jpg").alias("thumbnail_path"),
        scalar.segment_path(v, i, "transcripts", "json").alias("transcript_path"),
        F.format_string("raw/longs/audio/%s.wav", v).alias("long_audio_path"),
        short("audio", "wav").alias("short_audio_path"),
        short("metadata", "json").alias("short_metadata_path"),
        F.format_string("labels/%s_segments.csv", F.col("creator_id")).alias("labels_path"),
        F.format_string("pairs/%s_pairs.csv", F.col("creator_id")).alias("pairs_path"),
    )


def top_pairs(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
