"""Creator discovery: candidates, channel filters, video counts, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segmill import schema
from segmill.functions import scalar, text
from segmill.session import materialize


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """The place in a fixed order; what isn't listed comes last."""
    out = F.when(F.lit(False), 0)
    for k, v in enumerate(order):
        out = out.when(value == v, k)
    return out.otherwise(len(order))


def first_candidates(df: DataFrame, sources: Sequence[str] = ("seed", "channel_search", "video_search"), categories: Sequence[str] = schema.CATEGORIES) -> DataFrame:
    """One row per channel_id, by source and then by category in these orders."""
    order = F.struct(rank_of(F.col("source"), sources).alias("s"), rank_of(F.col("search_category"), categories).alias("c"), "source", "search_category")
    best = df.groupBy("channel_id").agg(F.min(order).alias("x"))
    return best.select("channel_id", "x.source", "x.search_category")


def normalise_items(items: DataFrame) -> DataFrame:
    """Nested items of the video API as sixteen flat columns."""
    count = lambda c: F.coalesce(F.col(f"statistics.{c}").try_cast("bigint"), F.lit(0).cast("bigint"))
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    return items.select(
        F.col("id").alias("video_id"),
        text_of("snippet.title").alias("title"),
        text_of("snippet.publishedAt").alias("published_at"),
        scalar.iso_seconds(F.col("contentDetails.duration")).alias("duration_seconds"),
        count("viewCount").alias("views"),
        count("likeCount").alias("likes"),
        count("commentCount").alias("comments"),
        text_of("snippet.description").alias("description"),
        F.coalesce(F.array_join("snippet.tags", "|"), F.lit("")).alias("tags"),
        text_of("snippet.categoryId").alias("category_id"),
        text_of("snippet.channelId").alias("channel_id"),
        text_of("snippet.channelTitle").alias("channel_title"),
        F.coalesce("snippet.thumbnails.high.url", "snippet.thumbnails.medium.url", "snippet.thumbnails.default.url", F.lit("")).alias("thumbnail_url"),
        text_of("snippet.defaultAudioLanguage").alias("default_audio_language"),
        text_of("contentDetails.definition").alias("definition"),
        text_of("contentDetails.caption").alias("has_captions"),
    )


def channel_filter(channels: DataFrame) -> DataFrame:
    """P2 with P3."""
    return channels.filter(
        (F.col("subscribers") >= schema.MIN_SUBSCRIBERS)
        & (F.col("total_videos") >= schema.MIN_VIDEOS)
        & scalar.english_country(F.col("country"), F.col("default_language"))
    )


def topics_table(df: DataFrame) -> DataFrame:
    """Topic, category, weight; as many rows as the fixed list has."""
    return df.sparkSession.createDataFrame(schema.TOPICS, "topic string, topic_category string, weight int")


def topic_category(topics: DataFrame, key: str = "channel_id") -> DataFrame:
    """The category with the largest sum of weights over a channel's topic urls, ties by the fixed
    order; null without any known topic. Every key of the input is in the result."""
    each = topics.select(key, F.explode_outer("topic_urls").alias("url")).select(key, text.url_topic(F.col("url")).alias("topic"))
    scored = each.join(F.broadcast(topics_table(topics)), "topic", "left").groupBy(key, "topic_category").agg(F.sum("weight").alias("score"))
    order = F.struct(F.coalesce("score", F.lit(0)).alias("s"), (-rank_of(F.col("topic_category"), schema.CATEGORIES)).alias("o"))
    return scored.groupBy(key).agg(F.max_by("topic_category", order).alias("category"), F.coalesce(F.max("score"), F.lit(0)).alias("score"))


def classify_videos(videos: DataFrame, allow_zero: bool = False) -> DataFrame:
    """With the class `short` or `long`; videos of neither class go."""
    return videos.withColumn("video_class", scalar.duration_class(F.col("duration_seconds"), allow_zero)).filter("video_class IS NOT NULL")


def recent_head(videos: DataFrame, by: str, as_of: Column, position: str = "position", shorts: int = 200, longs: int = 50, days: int = schema.MIN_AGE_DAYS) -> DataFrame:
    """Shorts old enough, then the first so many of each class in list order."""
    old = videos.filter((F.col("video_class") == "long") | (F.col("published_at").isNotNull() & ~scalar.too_recent(F.col("published_at"), as_of, days)))
    n = F.row_number().over(W.partitionBy(by, "video_class").orderBy(position, "video_id"))
    return old.withColumn("_n", n).filter(F.col("_n") <= F.when(F.col("video_class") == "short", shorts).otherwise(longs)).drop("_n")


def active_channels(videos: DataFrame, by: str, as_of: Column) -> DataFrame:
    """Per channel the counts of its classes and its latest upload, kept if there are enough
    of both and the upload is recent."""
    counts = videos.groupBy(by).agg(
        F.count_if(F.col("video_class") == "short").alias("shorts_count"),
        F.count_if(F.col("video_class") == "long").alias("longs_count"),
        F.max("published_at").alias("latest_upload"),
    )
    return counts.filter(
        (F.col("shorts_count") >= schema.MIN_SHORTS)
        & (F.col("longs_count") >= schema.MIN_LONGS)
        & (F.col("latest_upload") >= as_of - F.make_dt_interval(F.lit(schema.ACTIVE_DAYS)))
    )


def comments_disabled(videos: DataFrame, by: str, position: str = "position", head: int = 20) -> DataFrame:
    """None of the first so many shorts has a comment."""
    n = F.row_number().over(W.partitionBy(by).orderBy(position, "video_id"))
    first = videos.withColumn("_n", n).filter(F.col("_n") <= head)
    return first.groupBy(by).agg((~F.bool_or(F.coalesce(F.col("comments"), F.lit(0)) > 0)).alias("comments_disabled"))


def text_gate(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Texts long enough to be matched."""
    c = F.coalesce(F.col(column), F.lit(""))
    tests = {"long": F.length(c) > 100, "short": F.length(c) >= 20, "short_words": F.size(text.tokens(c)) >= 10}
    return df.filter(tests[kind])


def language_and_repurpose_gate(df: DataFrame) -> DataFrame:
    """P12."""
    return df.filter((F.col("whisper_en_prob") > 0.5) & (F.col("repurpose_matches") >= 2))


def creator_ids(creators: DataFrame, categories: Sequence[str] = schema.CATEGORIES) -> DataFrame:
    """CR0001... by category in the fixed order, then by subscribers, then by channel id.

    Numbers come from the partitions of a global sort and their sizes, so no window spans a category or
    the table.
    """
    ranked = creators.withColumn("_cat", rank_of(F.col("category"), categories)).orderBy("_cat", F.desc("subscribers"), "channel_id")
    x = numbered(in_order(ranked.drop("_cat"), "_part", "_at"), "_part", "_at")
    return x.withColumn("creator_id", F.format_string("CR%04d", F.col("position"))).select(*creators.columns, "creator_id")


def round_robin(creators: DataFrame, machines: int, by: str = "longs_count", ident: str = "creator_id") -> DataFrame:
    """Machines in turn, by the number of longs downwards and then by id. Ranks run among creators
    with equally many longs; what comes before them is a running sum over the distinct numbers."""
    sizes = creators.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(by, (F.sum("_n").over(W.orderBy(F.desc(by))) - F.col("_n")).alias("_before"))  # one row a number
    n = F.row_number().over(W.partitionBy(by).orderBy(ident))
    x = creators.withColumn("_k", n).join(before, by)
    return x.withColumn("vm_id", F.concat(F.lit("vm"), ((F.col("_before") + F.col("_k") - 1) % machines).cast("string"))).select(*creators.columns, "vm_id")


def pool(creators: DataFrame, done: DataFrame, active: DataFrame, key: str = "creator_id") -> DataFrame:
    """All that are neither done nor active."""
    return creators.join(done, key, "left_anti").join(active, key, "left_anti")


def members(df: DataFrame, creators: DataFrame, key: str = "creator_id") -> DataFrame:
    """Rows of known creators."""
    return df.join(creators.select(key), key, "left_semi")


def shuffled(df: DataFrame, seed: int, key: str = "creator_id") -> DataFrame:
    """T5: in an order that the seed and the key determine, whatever the partitions are."""
    return df.orderBy(shuffle_key(seed, F.col(key)), key)


def shuffle_key(seed: int, key: Column) -> Column:
    """What T5 sorts by: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def in_order(df: DataFrame, part: str = "part", at: str = "at") -> DataFrame:
    """What numbered() takes, from sorted rows."""
    return df.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()})


def numbered(df: DataFrame, part: str = "part", at: str = "at") -> DataFrame:
    """With `position`, counted from 1, of rows in order: `part` and `at` are the number of the row's
    partition and its monotonically increasing id. Only the partitions' sizes are put in one window."""
    df = materialize(df)
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(part, (F.sum("_n").over(W.orderBy(part)) - F.col("_n")).alias("_before"))  # a row a partition
    within = F.col(at).bitwiseAND((1 << 33) - 1)
    return df.join(F.broadcast(before), part).withColumn("position", F.col("_before") + within + 1).drop("_before")
