"""Queries over sources, sinks, reports and checks: what is written is read back and compared with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill import schema
from segmill.functions import text
from segmill.operators import discovery, metrics, segments, splits, validation
from segmill.plans import tables
from segmill.plans.registry import query
from segmill.plans.tables import read, sql
from segmill.session import shared_dir
from segmill.sources import readers, writers

SPLIT = "CASE WHEN ('0x' || substr(md5({0}), 1, 8))::BIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(md5({0}), 1, 8))::BIGINT % 100 < 85 THEN 'val' ELSE 'test' END"


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' segments as feature rows of thirteen creators, with the structural features."""
    x = segments.structural_features(tables.doc_segments(spark, sf))
    return x.withColumns(
        {
            "segment_id": F.col("segment_id").cast("string"), "creator_id": F.concat(F.lit("CR"), (F.col("segment_id") % 13).cast("string")),
            "label": F.col("label").cast("int"), "word_count": F.length("text").cast("double"), "features_version": F.lit("a, \"b\"\nc"),
        }
    )


STRUCT = """f AS (
  SELECT CAST(segment_id AS VARCHAR) AS segment_id, 'CR' || (segment_id % 13) AS creator_id, video_id, category, segment_index, CAST(label AS INTEGER) AS label, CAST(length(text) AS DOUBLE) AS word_count,
         round(start_time / greatest(video_duration, 1e-6), 4) AS position_ratio, round(end_time - start_time, 2) AS segment_duration, round(video_duration, 2) AS video_duration FROM segments)"""
FEATURE_COLS = ["segment_id", "video_id", "creator_id", "category", "segment_index", "label", "word_count", "position_ratio", "segment_duration", "video_duration"]


@query(sql("segs", body=f", {STRUCT} SELECT {', '.join(FEATURE_COLS)}, true AS quoted, 0::BIGINT AS others FROM f"))
def feature_files(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file for each creator, with quoted line breaks; read back with its header, columns and ids checked."""
    out = shared_dir(spark)
    writers.named_files(writers.ordered(_features(spark, sf)).withColumn("creator", F.col("creator_id")), out, ["creator"], "{creator}_features.csv", header=True, escape='"')
    x = readers.features(spark, out)
    others = sum((F.col(c).isNotNull().cast("bigint") for c in schema.GROUPS["audio_speech"]), F.lit(0).cast("bigint"))
    return x.select(*FEATURE_COLS, (F.col("features_version") == "a, \"b\"\nc").alias("quoted"), others.alias("others"))


@query(sql("segs", body=f", {STRUCT} SELECT creator_id || '_features.csv' AS file_name, count(*) AS n_rows, round((count(*) * 2 - count(nullif(label, 0)) - count(*)) / (count(*) * 2.0::DOUBLE), 6) AS null_share FROM f GROUP BY creator_id"))
def file_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and the share of nulls of each file."""
    out = shared_dir(spark)
    x = _features(spark, sf).select("creator_id", "segment_id", F.nullif("label", F.lit(0)).alias("label"))
    writers.named_files(x, out, ["creator_id"], "{creator_id}_features.csv", header=True)
    return readers.file_report(readers.csv(spark, out, "segment_id string, label int", extra=True))


@query(sql("segs", body=f""", {STRUCT}, s AS (SELECT *, CAST(substr(creator_id, 3) AS INTEGER) % 3 AS kind FROM f)
SELECT creator_id || '_features.csv' AS file_name, CASE WHEN any_value(kind) = 1 THEN 'label' ELSE '' END AS missing, CASE WHEN any_value(kind) = 1 THEN 'note' ELSE '' END AS extra,
       CASE any_value(kind) WHEN 0 THEN 0.0 WHEN 2 THEN round((count(*) - count(nullif(label, 0))) / (count(*) * 3.0::DOUBLE), 6) END AS null_share,
       any_value(kind) = 0 OR any_value(kind) = 2 AND (count(*) - count(nullif(label, 0))) / (count(*) * 3.0::DOUBLE) <= 0.005 AS passes FROM s GROUP BY creator_id"""))
def verify_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files as they should be, with another column instead of one, and with nulls, told apart."""
    out = shared_dir(spark)
    kind = F.substring("creator_id", 3, 9).cast("int") % 3
    x = _features(spark, sf).select("creator_id", "segment_id", "label", "word_count", kind.alias("kind"))
    files = [
        x.filter("kind = 0").select("creator_id", "segment_id", "label", "word_count"),
        x.filter("kind = 1").select("creator_id", "segment_id", F.lit("a").alias("note"), "word_count"),
        x.filter("kind = 2").select("creator_id", "segment_id", F.nullif("label", F.lit(0)).alias("label"), "word_count"),
    ]
    for df in files:
        writers.named_files(df, out, ["creator_id"], "{creator_id}_features.csv", header=True)
    return readers.verify_files(spark, out, "segment_id string, label int, word_count double")


@query(sql("pairs", body="SELECT 'CR' || (long_id % 7) AS creator_id, CAST(short_id AS VARCHAR) AS short_id, CAST(long_id AS VARCHAR) AS long_id, matched_segment_index, match_score FROM pairs"))
def pair_files(spark: SparkSession, sf: str) -> DataFrame:
    """The creator is told by the file's name."""
    out = shared_dir(spark)
    names = [c.split()[0] for c in schema.SCHEMAS["whisper_pairs"].split(", ")]
    p = tables.pairs(spark, sf).withColumns({"creator": F.concat(F.lit("CR"), (F.col("long_id") % 7).cast("string")), "match_method": F.lit("whisper")})
    have = set(p.columns)
    rows = p.select("creator", *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in names])
    writers.named_files(rows, out, ["creator"], "{creator}_pairs.csv", header=True)
    return readers.pairs(spark, out).select("creator_id", "short_id", "long_id", "matched_segment_index", "match_score")


@query(sql("segs", "videos", body="""SELECT 'segments' AS table_name, count(*) AS n_rows, count(DISTINCT segment_id) AS n_ids, count(*) FILTER (WHERE label NOT IN (0, 1)) AS n_bad FROM segments
UNION ALL SELECT 'shorts', count(*), count(DISTINCT video_id), 0 FROM videos"""))
def collection_merge(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the tables of a collection written by creator, read as one collection and counted."""
    out = shared_dir(spark)
    s = tables.doc_segments(spark, sf).select(F.col("segment_id").cast("string"), F.col("video_id"), (F.col("segment_id") % 5).cast("string").alias("creator_id"), "segment_index", F.col("label").cast("int"))
    v = tables.shorts(spark, sf).select(F.col("video_id").cast("string"), (F.col("creator_id") % 5).cast("string").alias("creator_id"), "views", "likes", "comments", "engagement_rate")
    paths = {"segments": f"{out}/segments", "shorts": f"{out}/shorts"}
    for df, name in ((s, "segments"), (v, "shorts")):
        columns = [c.split()[0] for c in schema.SCHEMAS[name].split(", ")]
        writers.named_files(writers.ordered(df, columns).withColumn("creator", F.col("creator_id")), paths[name], ["creator"], "CR{creator}_" + name + ".csv", header=True)
    got = readers.collection(spark, paths)
    one = lambda name, key, bad: got[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_ids"), F.count_if(bad).alias("n_bad"))
    return one("segments", "segment_id", ~F.col("label").isin(0, 1)).union(one("shorts", "video_id", F.lit(False)))


EMB = "e AS (SELECT 'src' || label AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS segment_index, embedding FROM embeddings)"


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    at = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    return read(spark, sf, "embeddings").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("video_id"), at.alias("segment_index"), "embedding")


@query(f"WITH {EMB} SELECT video_id, segment_index, len(embedding)::INTEGER AS size, embedding[1]::DOUBLE AS first_value, embedding[len(embedding)]::DOUBLE AS last_value FROM e")
def embedding_files(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors under one key `video|index`, of checked length; a later file wins."""
    out = shared_dir(spark)
    e = _embeddings(spark, sf)
    size = len(e.first()["embedding"])
    writers.embeddings(e, out)
    x = readers.embeddings(spark, out, size)
    return x.select("video_id", "segment_index", F.size("embedding").alias("size"), F.col("embedding")[0].cast("double").alias("first_value"), F.element_at("embedding", -1).cast("double").alias("last_value"))


@query(f"WITH {EMB} SELECT video_id, segment_index, len(embedding)::INTEGER AS size, embedding[1]::DOUBLE AS first_value, embedding[len(embedding)]::DOUBLE AS last_value FROM e")
def embedding_archives(spark: SparkSession, sf: str) -> DataFrame:
    """S12 and S5 as numpy archives, one a video."""
    out = shared_dir(spark)
    writers.embedding_archives(_embeddings(spark, sf), out)
    x = readers.npz_embeddings(spark, f"{out}/*.npz")
    return x.select("video_id", "segment_index", F.size("embedding").alias("size"), F.col("embedding")[0].cast("double").alias("first_value"), F.element_at("embedding", -1).cast("double").alias("last_value"))


@query(sql("segs", body=f""", {EMB} SELECT CAST(segment_id AS VARCHAR) AS segment_id, e.embedding IS NOT NULL AS has_embedding, coalesce(e.embedding[1], 0)::DOUBLE AS first_value
FROM segments s LEFT JOIN e ON e.video_id = s.video_id AND e.segment_index = s.segment_index"""))
def attach_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Zeros where a segment has no vector."""
    s = tables.doc_segments(spark, sf).select(F.col("segment_id").cast("string").alias("segment_id"), "video_id", "segment_index")
    x = segments.attach_embeddings(s, _embeddings(spark, sf), 64)
    return x.select("segment_id", "has_embedding", F.col("embedding")[0].cast("double").alias("first_value"))


@query("SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(turn AS INTEGER) AS segment_index, sha256(text) AS digest, 2 AS n_words FROM conversations WHERE regexp_replace(text, '^ +| +$', '', 'g') <> ''")
def transcript_files(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON file for each segment; blank texts are left out, and a damaged file is passed over."""
    out = shared_dir(spark)
    word = lambda w, a: F.struct(F.lit(w).alias("word"), F.lit(a).alias("start"), F.lit(a + 0.5).alias("end"))
    x = tables.turns(spark, sf).select("video_id", "segment_index", "text", F.array(word("a", 0.0), word("b", 1.0)).alias("words"))
    writers.named_files(x, out, ["video_id", "segment_index"], "{video_id}/segment_{segment_index}.json", "json")
    spark.createDataFrame([('{"text": "cut off',)], "value string").coalesce(1).write.text(f"{out}/damaged")
    got = readers.transcripts(spark, f"{out}/*")
    return got.select("video_id", "segment_index", F.sha2("text", 256).alias("digest"), F.size("words").alias("n_words"))


@query("SELECT CAST(doc_id AS VARCHAR) AS video_id, length(text) + 9 AS n_chars, sha256('WEBVTT' || chr(10) || chr(10) || text || chr(10)) AS digest FROM documents")
def caption_files(spark: SparkSession, sf: str) -> DataFrame:
    """Whole files of text, a video's id from the name."""
    out = shared_dir(spark)
    x = read(spark, sf, "documents").select(F.col("doc_id"), F.concat(F.lit("WEBVTT\n\n"), "text").alias("value"))
    x = x.withColumn("folder", F.floor(F.col("doc_id") / 4096))  # so that no task lists very many files
    writers.named_files(x, out, ["folder", "doc_id"], "{folder}/{doc_id}.en.vtt", "text")
    got = readers.captions(spark, f"{out}/*")
    return got.select("video_id", F.length("vtt").alias("n_chars"), F.sha2("vtt", 256).alias("digest"))


@query(sql("segs", body=f""", {STRUCT}, s AS (SELECT *, {SPLIT.format('video_id')} AS split FROM f)
SELECT segment_id, video_id, split, label, word_count, position_ratio::FLOAT::DOUBLE AS position_ratio FROM s WHERE split = 'train'"""))
def split_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix partitioned by split; one split is read, its features as float."""
    out = shared_dir(spark)
    writers.matrix(splits.group_split(_features(spark, sf)), out)
    x = splits.load_split(spark.read.parquet(out), "train", ["word_count", "position_ratio"])
    return x.select("segment_id", "video_id", "split", "label", F.col("word_count").cast("double").alias("word_count"), F.col("position_ratio").cast("double").alias("position_ratio"))


RESULT = "r AS (SELECT source AS model, count(*) / 8192.0::DOUBLE AS auc_roc, count(DISTINCT lang) / 4.0::DOUBLE AS f1, max(doc_id) / 1.0::DOUBLE AS p3, min(doc_id) / 1.0::DOUBLE AS n10 FROM documents GROUP BY 1)"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy(F.col("source").alias("model")).agg(
        (F.count(F.lit(1)) / F.lit(8192.0)).alias("auc_roc"), (F.countDistinct("lang") / F.lit(4.0)).alias("f1"), F.max("doc_id").cast("double").alias("p3"), F.min("doc_id").cast("double").alias("n10")
    )


@query(f"""WITH {RESULT}
SELECT model, unnest(['auc_roc', 'f1', 'precision_at_3', 'ndcg_at_10']) AS metric, unnest([auc_roc, f1, p3, n10]) AS value, NULL::DOUBLE AS std FROM r
UNION ALL SELECT model || '_seeds', 'auc_roc', auc_roc, 0.25 FROM r""")
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Result files of both shapes, of one run and of aggregated seeds, read as one table."""
    out = shared_dir(spark)
    r = _results(spark, sf)
    one = r.select("model", "auc_roc", "f1", F.create_map(F.lit("3"), "p3").alias("precision_at_k"), F.create_map(F.lit("10"), "n10").alias("ndcg_at_k"))
    many = r.select(F.concat("model", F.lit("_seeds")).alias("model"), F.create_map(F.lit("auc_roc"), F.struct(F.col("auc_roc").alias("mean"), F.lit(0.25).alias("std"))).alias("metrics"))
    writers.named_files(one, f"{out}/one", ["model"], "{model}_test.json", "json")
    writers.named_files(many, f"{out}/many", ["model"], "{model}_aggregated.json", "json")
    return readers.results(spark, f"{out}/*")


REPORT = f"""WITH {RESULT},
l AS (SELECT row_number() OVER (ORDER BY auc_roc DESC NULLS LAST, model) AS number, '| ' || model || ' | ' || printf('%.2f', f1) || ' | ' || printf('%.2f', n10) || ' |' AS line FROM r)"""


@query(REPORT + " SELECT CAST(number AS INTEGER) AS number, line FROM l UNION ALL SELECT -1, '| model | f1 | n10 |' UNION ALL SELECT 0, '|---|---|---|'")
def report(spark: SparkSession, sf: str) -> DataFrame:
    """A report in Markdown, the best first."""
    r = _results(spark, sf)
    lines = writers.report(r.select("model", "f1", "n10", "auc_roc"), [F.col("auc_roc").desc_nulls_last(), F.col("model")], 2, hide=["auc_roc"])
    return lines


@query(f"WITH {RESULT} SELECT model, CAST(row_number() OVER (ORDER BY p3 DESC, model) AS INTEGER) AS number FROM r")
def report_order(spark: SparkSession, sf: str) -> DataFrame:
    """T4: the rows of a report in order; numbered as they come, since a result has no order of its own."""
    x = discovery.numbered(discovery.in_order(metrics.report_order(_results(spark, sf), "p3", "model")))
    return x.select("model", F.col("position").cast("int").alias("number"))


@query("SELECT d.doc_id, coalesce(b.text, '') AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def with_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """A missing text is ''."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("segment_id"))
    t = read(spark, sf, "benchmark").select(F.col("item_id").alias("segment_id"), "text")
    return splits.with_transcripts(d, t).withColumnRenamed("segment_id", "doc_id")


@query(sql("segs", body=f", {STRUCT} SELECT segment_id, video_id, label, position_ratio, segment_duration, video_duration FROM f"))
def feature_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The features of one group only."""
    x = splits.feature_subset(writers.ordered(_features(spark, sf)), ["structural"])
    if "word_count" in x.columns:
        raise ValueError("a column of another group")
    return x.select("segment_id", "video_id", "label", "position_ratio", "segment_duration", "video_duration")


@query(f"SELECT source, count(DISTINCT {SPLIT.format('CAST(doc_id AS VARCHAR)')}) AS n_splits FROM documents GROUP BY 1 HAVING n_splits > 1")
def leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Split by document, nearly every source is in several splits."""
    return splits.leaks(splits.group_split(read(spark, sf, "documents"), "doc_id"), "source")


RMS = """WITH v AS (SELECT l_orderkey AS segment_id, list(l_quantity * l_discount / 100 ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY 1),
m AS (SELECT *, list_avg(a) AS m, len(a) AS n FROM v)"""


@query(RMS + """ SELECT segment_id, round(m, 9) AS energy_mean, round(sqrt(list_avg(list_transform(a, lambda x: (x - m) * (x - m)))), 9) AS energy_dev,
round(CASE WHEN m > 0 THEN list_avg(a[1 : least(n, 3)]) / m ELSE 1 END, 6) AS energy_first_3s_ratio, round(list_avg(list_transform(a, lambda x: CASE WHEN x < (CASE WHEN m > 0.005 THEN m * 0.1 ELSE 0.005 END) THEN 1.0 ELSE 0.0 END)), 6) AS silence_ratio FROM m""")
def energy_features(spark: SparkSession, sf: str) -> DataFrame:
    """A22, one frame a second."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * F.col("l_discount") / 100).alias("x"))))
    x = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("segment_id")).agg(F.transform(rows, lambda s: s["x"]).alias("rms"))
    x = segments.energy_features(x.withColumn("fps", F.lit(1)))
    return x.select("segment_id", F.round("energy_mean", 9).alias("energy_mean"), F.round(F.sqrt("energy_var"), 9).alias("energy_dev"), F.round("energy_first_3s_ratio", 6).alias("energy_first_3s_ratio"), F.round("silence_ratio", 6).alias("silence_ratio"))


@query("SELECT event_id, max(user_id) OVER (PARTITION BY user_id % 97 ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 43 FOLLOWING) AS window_max FROM events")
def sliding_max(spark: SparkSession, sf: str) -> DataFrame:
    """Over 44 frames."""
    x = read(spark, sf, "events").select("event_id", "user_id", (F.col("user_id") % 97).alias("segment"))
    return segments.sliding_max(x, "user_id", "segment", "event_id").select("event_id", "window_max")


@query("""WITH p AS (SELECT l_orderkey AS segment_id, l_linenumber % 2 AS frame, l_partkey % 256 AS r, l_suppkey % 256 AS g, (l_quantity * 5)::BIGINT % 256 AS b FROM lineitem),
f AS (SELECT segment_id, frame, sqrt(stddev_pop(abs(r - g)) ^ 2 + stddev_pop(abs((r + g) * 0.5::DOUBLE - b)) ^ 2) + 0.3 * sqrt(avg(abs(r - g)) ^ 2 + avg(abs((r + g) * 0.5::DOUBLE - b)) ^ 2) AS c, avg(greatest(r, g, b)) / 255 AS v FROM p GROUP BY 1, 2)
SELECT segment_id, round(avg(c), 6) AS colorfulness, round(avg(v), 6) AS brightness_mean FROM f GROUP BY 1""")
def colour_features(spark: SparkSession, sf: str) -> DataFrame:
    """A21."""
    p = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("segment_id"), (F.col("l_linenumber") % 2).alias("frame"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), ((F.col("l_quantity") * 5).cast("bigint") % 256).alias("b")
    )
    return segments.colour_features(p).select("segment_id", F.round("colorfulness", 6).alias("colorfulness"), F.round("brightness_mean", 6).alias("brightness_mean"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS BIGINT) AS position FROM customer")
def shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """T5: numbered as they come, from the number of rows in the partitions before."""
    x = discovery.shuffled(read(spark, sf, "customer").select("c_custkey"), 42, "c_custkey")
    x = x.select("c_custkey", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    return discovery.numbered(x).select("c_custkey", "position")


@query("SELECT c_custkey AS creator_id, c_name AS name, c_acctbal AS balance, c_mktsegment AS category FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def bag_union(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats stay, a column that one side lacks is null."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("creator_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("category"))
    s = read(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("creator_id"), F.col("s_acctbal").alias("balance"))
    return validation.bag_union([c, s])


@query("SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def rows_missing(spark: SparkSession, sf: str) -> DataFrame:
    """U3 for data."""
    return validation.rows_missing(read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("""SELECT c_custkey, list_filter([trim(x) FOR x IN string_split(c_name || ', nan,' || c_mktsegment || ',, ' || c_nationkey, ',')], lambda x: x NOT IN ('', 'nan')) AS ids, 'UU' || substr(c_name, 3) AS playlist FROM customer""")
def id_lists(spark: SparkSession, sf: str) -> DataFrame:
    """F10 and F11."""
    c = read(spark, sf, "customer")
    listed = F.concat("c_name", F.lit(", nan,"), "c_mktsegment", F.lit(",, "), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", text.id_list(listed).alias("ids"), text.uploads_playlist(F.col("c_name")).alias("playlist"))


@query(sql("segs", body=f""", {STRUCT}, g AS (SELECT unnest(['text', 'audio_speech', 'voice_quality', 'audio_events', 'audio_emotion', 'visual', 'structural', 'creator_context']) AS group_name,
       unnest([10, 7, 2, 4, 7, 41, 8, 5]) AS n_columns, unnest([1, 0, 0, 0, 0, 0, 7, 0]) AS filled)
SELECT group_name, CAST(n_columns AS INTEGER) AS n_columns, count(segment_id) AS n_rows, CAST(count(segment_id) * any_value(filled) AS BIGINT) AS n_values FROM g, f GROUP BY 1, 2"""))
def column_groups(spark: SparkSession, sf: str) -> DataFrame:
    """V2: the groups are disjoint and cover the feature columns, and how many values of each the feature rows have."""
    schema.check_groups()
    x = writers.ordered(_features(spark, sf))
    have = lambda columns: sum((F.count(F.col(c)) for c in columns), F.lit(0).cast("bigint"))
    one = x.agg(F.count(F.lit(1)).alias("n"), *[have(columns).alias(g) for g, columns in schema.GROUPS.items()])
    each = F.array(*[F.struct(F.lit(g).alias("group_name"), F.lit(len(columns)).alias("n_columns"), F.col(g).alias("n_values")) for g, columns in schema.GROUPS.items()])
    return one.select("n", F.explode(each).alias("g")).select("g.group_name", "g.n_columns", F.col("n").alias("n_rows"), "g.n_values")
