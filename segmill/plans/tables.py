"""The data model's tables made from the star-schema test tables, as DataFrames.

Each has its SQL twin in CTES, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.operators.ranges import index_within
from segmill.session import parts_of, spread

AS_OF = "2001-08-02 00:00:00"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def creators(spark: SparkSession, sf: str) -> DataFrame:
    """Customers: the market segment is the category, the balance gives subscribers."""
    c = read(spark, sf, "customer")
    names = {"BUILDING": "tech", "AUTOMOBILE": "education", "MACHINERY": "entertainment", "HOUSEHOLD": "fitness", "FURNITURE": "commentary"}
    category = F.when(F.lit(False), "")
    for k, v in names.items():
        category = category.when(F.col("c_mktsegment") == k, v)
    countries = F.array(*map(F.lit, ["US", "IN", "", "SE", "DE"]))
    languages = F.array(*map(F.lit, ["", "en-IN", "hi"]))
    return c.select(
        F.col("c_custkey").alias("creator_id"),
        F.col("c_name").alias("channel_id"),
        category.alias("category"),
        F.floor(F.abs("c_acctbal") * 100).cast("bigint").alias("subscribers"),
        (F.col("c_custkey") % 97).alias("total_videos"),
        F.element_at(countries, (F.col("c_nationkey") % 5 + 1).cast("int")).alias("country"),
        F.element_at(languages, (F.col("c_custkey") % 3 + 1).cast("int")).alias("default_language"),
    )


def videos(spark: SparkSession, sf: str) -> DataFrame:
    """Orders: views from the price, likes from discounts, comments from the number of lines."""
    cents = F.floor(F.col("l_extendedprice") * F.col("l_discount") * 100 + 1e-6).cast("bigint")
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("lines"))
    o = read(spark, sf, "orders")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("video_id"),
        F.col("o_custkey").alias("creator_id"),
        F.floor("o_totalprice").cast("bigint").alias("views"),
        F.floor(F.coalesce("cents", F.lit(0)) / 100.0).cast("bigint").alias("likes"),
        F.coalesce("lines", F.lit(0)).alias("comments"),
        F.col("o_orderdate").alias("published_at"),
        (F.col("o_orderkey") % 600).cast("int").alias("duration_seconds"),
        F.col("o_orderkey").alias("position"),
    )


def shorts(spark: SparkSession, sf: str) -> DataFrame:
    from segmill.operators.engagement import engagement

    return engagement(videos(spark, sf), as_of())


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as matches of a short (the order) with a segment of a long (the part)."""
    t = read(spark, sf, "lineitem")
    x = t.select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber").repartition(parts_of(t), "l_orderkey", "l_partkey")  # hardly a key repeats
    return x.groupBy("l_orderkey", "l_partkey").agg(
        F.max(F.col("l_quantity") + 50.0).alias("match_score"), F.min("l_linenumber").alias("line")
    ).select(
        F.col("l_orderkey").alias("short_id"), (F.col("l_partkey") % 200).alias("long_id"), (F.col("line") - 1).cast("int").alias("matched_segment_index"),
        "match_score", (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("pos"),
    )


def doc_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with labels as segments of their source: half a minute each, in the order of ids."""
    d, lab = read(spark, sf, "documents"), read(spark, sf, "labels")
    x = index_within(d.join(lab, "doc_id"), "source", "doc_id", "segment_index", "_size").withColumn("segment_index", F.col("segment_index").cast("int"))
    x = x.withColumn("video_duration", (F.col("_size") * 30).cast("double"))
    return x.select(
        F.col("doc_id").alias("segment_id"), F.col("source").alias("video_id"), F.col("lang").alias("category"), "segment_index", F.col("toxic").alias("label"), "quality", "text",
        (F.col("segment_index") * 30.0).cast("double").alias("start_time"), ((F.col("segment_index") + 1) * 30.0).cast("double").alias("end_time"),
        "video_duration", (F.col("n_chars") / F.lit(15.0)).alias("duration"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as segments with transcripts; 15 characters a second."""
    c = read(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("segment_index"), "role", "text", (F.length("text") / F.lit(15.0)).alias("duration"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of three models and two seeds on the document segments, with many ties."""
    d = spread(doc_segments(spark, sf).select("video_id", "segment_id", "label"), "video_id", "segment_id")
    ms = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"), F.lit(k).alias("k")) for m, s, k in SCORERS])
    x = d.withColumn("m", F.explode(ms)).select("m.model", "m.seed", "m.k", "video_id", "segment_id", F.col("label").cast("int").alias("y"))
    h = F.pmod(F.col("segment_id") * F.col("k") + F.col("k"), F.lit(23)) / F.lit(32.0)
    return x.select("model", "seed", F.lit("test").alias("split"), "video_id", "segment_id", "y", h.alias("score"))


SCORERS = [("a", 0, 7), ("a", 1, 11), ("b", 0, 13), ("b", 1, 17), ("c", 0, 5), ("c", 1, 19)]

#: SQL twins, to be put after WITH.
CTES = {
    "creators": """creators AS (
  SELECT c_custkey AS creator_id, c_name AS channel_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'tech' WHEN 'AUTOMOBILE' THEN 'education' WHEN 'MACHINERY' THEN 'entertainment'
              WHEN 'HOUSEHOLD' THEN 'fitness' WHEN 'FURNITURE' THEN 'commentary' END AS category,
         CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS subscribers, c_custkey % 97 AS total_videos,
         list_extract(['US', 'IN', '', 'SE', 'DE'], c_nationkey % 5 + 1) AS country,
         list_extract(['', 'en-IN', 'hi'], c_custkey % 3 + 1) AS default_language
  FROM customer)""",
    "videos": """lines AS (
  SELECT l_orderkey, sum(CAST(floor(l_extendedprice * l_discount * 100 + 1e-6) AS BIGINT)) AS cents, count(*) AS lines FROM lineitem GROUP BY 1),
videos AS (
  SELECT o_orderkey AS video_id, o_custkey AS creator_id, CAST(floor(o_totalprice) AS BIGINT) AS views,
         CAST(floor(coalesce(cents, 0) / 100.0) AS BIGINT) AS likes, coalesce(lines, 0) AS comments, o_orderdate AS published_at,
         CAST(o_orderkey % 600 AS INTEGER) AS duration_seconds, o_orderkey AS position
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey)""",
    "shorts": """shorts AS (
  SELECT *, CAST(greatest(floor((epoch(TIMESTAMP '2001-08-02') - epoch(published_at)) / 86400), 1) AS INTEGER) AS days_since_published,
         round(CASE WHEN views > 0 THEN CAST(likes + comments AS DOUBLE) / views ELSE 0 END, 6) AS engagement_rate,
         round(CASE WHEN greatest(floor((epoch(TIMESTAMP '2001-08-02') - epoch(published_at)) / 86400), 1) > 0
               THEN CAST(views AS DOUBLE) / greatest(floor((epoch(TIMESTAMP '2001-08-02') - epoch(published_at)) / 86400), 1) ELSE 0 END, 1) AS views_per_day,
         'standard' AS engagement_formula,
         CASE WHEN epoch(TIMESTAMP '2001-08-02') - epoch(published_at) < 7 * 86400 THEN 'too_recent' ELSE '' END AS excluded_reason
  FROM videos)""",
    "base": """base AS (
  SELECT creator_id, CAST(count(*) FILTER (WHERE excluded_reason = '') AS INTEGER) AS total_shorts_analysed,
         CAST(count(*) FILTER (WHERE excluded_reason <> '') AS INTEGER) AS shorts_excluded_too_recent,
         floor(median(CAST(round(engagement_rate * 1000000) AS BIGINT)) FILTER (WHERE excluded_reason = '') + 0.5::DOUBLE) / 1000000.0::DOUBLE AS median_engagement_rate,
         floor(avg(CAST(round(engagement_rate * 1000000) AS BIGINT)) FILTER (WHERE excluded_reason = '') + 0.5::DOUBLE) / 1000000.0::DOUBLE AS mean_engagement_rate,
         CAST(trunc(median(views) FILTER (WHERE excluded_reason = '')) AS BIGINT) AS median_views,
         CAST(trunc(avg(views) FILTER (WHERE excluded_reason = '')) AS BIGINT) AS mean_views,
         CAST(trunc(coalesce(stddev_samp(views) FILTER (WHERE excluded_reason = ''), 0)) AS BIGINT) AS std_views,
         floor(median(CAST(round(views_per_day * 10) AS BIGINT)) FILTER (WHERE excluded_reason = '') + 0.5::DOUBLE) / 10.0::DOUBLE AS median_views_per_day,
         floor(avg(CAST(round(views_per_day * 10) AS BIGINT)) FILTER (WHERE excluded_reason = '') + 0.5::DOUBLE) / 10.0::DOUBLE AS mean_views_per_day,
         CAST(trunc(median(likes) FILTER (WHERE excluded_reason = '')) AS BIGINT) AS median_likes,
         CAST(trunc(median(comments) FILTER (WHERE excluded_reason = '')) AS BIGINT) AS median_comments,
         false AS comments_disabled, 'standard' AS engagement_formula_used
  FROM shorts GROUP BY 1 HAVING count(*) FILTER (WHERE excluded_reason = '') > 0)""",
    "pairs": """pairs AS (
  SELECT l_orderkey AS short_id, l_partkey % 200 AS long_id, CAST(min(l_linenumber) - 1 AS INTEGER) AS matched_segment_index,
         max(l_quantity + 50.0) AS match_score, l_orderkey * 100000 + l_partkey AS pos
  FROM lineitem GROUP BY l_orderkey, l_partkey)""",
    "labelled": """labelled AS (
  SELECT p.short_id, s.creator_id, p.long_id, p.matched_segment_index, p.match_score, p.pos, s.views AS short_views, s.likes AS short_likes, s.comments AS short_comments,
         s.engagement_rate AS short_engagement_rate, s.views_per_day AS short_views_per_day,
         b.median_engagement_rate AS creator_median_engagement_rate, b.median_views_per_day AS creator_median_views_per_day,
         coalesce(b.median_engagement_rate > 0 AND s.engagement_rate > 2.0::DOUBLE * b.median_engagement_rate, false) AS meets_engagement_threshold,
         coalesce(b.median_views_per_day > 0 AND s.views_per_day > 3.0::DOUBLE * b.median_views_per_day, false) AS meets_views_threshold
  FROM pairs p JOIN shorts s ON s.video_id = p.short_id LEFT JOIN base b ON b.creator_id = s.creator_id),
marked AS (SELECT *, CAST(meets_engagement_threshold OR meets_views_threshold AS INTEGER) AS label FROM labelled)""",
    "segs": """segs AS (
  SELECT d.doc_id AS segment_id, d.source AS video_id, d.lang AS category, CAST(row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1 AS INTEGER) AS segment_index,
         l.toxic AS label, l.quality, d.text, CAST(count(*) OVER (PARTITION BY source) * 30 AS DOUBLE) AS video_duration, d.n_chars / 15.0::DOUBLE AS duration
  FROM documents d JOIN labels l USING (doc_id)),
segments AS (SELECT *, segment_index * 30.0::DOUBLE AS start_time, (segment_index + 1) * 30.0::DOUBLE AS end_time FROM segs)""",
    "scores": """scores AS (
  SELECT m.model, m.seed, 'test' AS split, video_id, segment_id, CAST(label AS INTEGER) AS y, ((segment_id * m.k + m.k) % 23) / 32.0::DOUBLE AS score
  FROM segments, (VALUES """
    + ", ".join(f"('{m}', {s}, {k})" for m, s, k in SCORERS)
    + """) AS m(model, seed, k))""",
}


def sql(*names: str, body: str) -> str:
    """CTES and then the body; a body that begins with a comma goes on with CTEs of its own."""
    return "WITH " + ",\n".join(CTES[n] for n in names) + "\n" + body
