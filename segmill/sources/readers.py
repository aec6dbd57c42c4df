"""Readers (S1-S7, S14, S15)."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill import schema
from segmill.operators.validation import check_columns, check_unique
from segmill.session import ship

#: Bytes of files that a task reads into one batch.
READ_BYTES = 8 << 20
CREATOR_FILE = r"^(CR\d+)_"


def csv(spark: SparkSession, path: str, ddl: str, extra: bool = False) -> DataFrame:
    """CSV with a header, quoted line breaks allowed; files that go missing meanwhile are skipped. With
    `extra` also the hidden column of the file's name."""
    df = (
        spark.read.schema(ddl).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).option("ignoreMissingFiles", True).csv(path)
    )
    return df.select("*", F.col("_metadata.file_name").alias("file_name")) if extra else df


def creator_of(file_name: Column) -> Column:
    """The creator's id from the file's name."""
    return F.nullif(F.regexp_extract(file_name, CREATOR_FILE, 1), F.lit(""))


def features(spark: SparkSession, path: str, ddl: str = schema.SCHEMAS["features"], unique: bool = True) -> DataFrame:
    """All creators' feature files; headers must agree with the schema, ids must be unique."""
    df = csv(spark, path, ddl)
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    check_columns(head, df.columns)
    return check_unique(df) if unique else df


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair files, with creator_id from the name."""
    df = csv(spark, path, schema.SCHEMAS["whisper_pairs"], extra=True)
    return df.withColumn("creator_id", creator_of(F.col("file_name"))).drop("file_name")


def collection(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """S3: the tables of a collection, by name (segments, whisper_pairs, shorts, ...)."""
    return {name: csv(spark, path, schema.SCHEMAS[name]) for name, path in paths.items()}


def file_report(df: DataFrame) -> DataFrame:
    """Rows and null share by file, of a frame read with extra=True."""
    cols = [c for c in df.columns if c != "file_name"]
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(nulls) / (F.count(F.lit(1)) * len(cols)), 6).alias("null_share"))


def verify_files(spark: SparkSession, path: str, ddl: str, most_null: float = 0.005) -> DataFrame:
    """For each CSV file which of the expected columns its header lacks and which others it has, both as
    sorted lists with commas, the share of nulls among the expected values (null where columns differ), and
    whether it passes. Headers come from the files' first lines, however many lines a value has."""
    expected = [c.split()[0].strip("`") for c in ddl.split(", ")]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("_from"))
    first = lines.filter("_from = 0").withColumn("_at", F.monotonically_increasing_id()).groupBy("file_name").agg(F.min_by("value", "_at").alias("head"))
    have = F.transform(F.split("head", ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    want = F.array(*map(F.lit, expected))
    text = lambda a: F.array_join(F.sort_array(a), ",")
    heads = first.select("file_name", text(F.array_except(want, have)).alias("missing"), text(F.array_except(have, want)).alias("extra"))
    # Values as text and by place, whatever the header: the share only counts where the columns are those expected.
    texts = ", ".join(f"`{c}` string" for c in expected)
    values = spark.read.schema(texts).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    shares = file_report(values.select("*", F.col("_metadata.file_name").alias("file_name")))
    x = heads.join(shares, "file_name", "left")
    same = (F.col("missing") == "") & (F.col("extra") == "")
    return x.select("file_name", "missing", "extra", F.when(same, F.col("null_share")).alias("null_share"), (same & (F.coalesce("null_share", F.lit(1.0)) <= most_null)).alias("passes"))


def split_key(key: Column) -> tuple[Column, Column]:
    """`video|index`, cut at the last bar."""
    shape = r"^(.*)\|(\d+)$"
    return F.regexp_extract(key, shape, 1), F.regexp_extract(key, shape, 2).try_cast("int")


def embeddings(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """Vectors by (video, index) from Parquet with (segment_key, embedding); of several files with the
    same key the later name wins, and vectors of another length are an error."""
    df = spark.read.schema(schema.SCHEMAS["clip_embeddings"]).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"))
    if size:
        wrong = F.raise_error(F.format_string("vector of %d values", F.size("embedding")))
        df = df.withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(wrong.cast("array<float>")))
    video, index = split_key(F.col("segment_key"))
    x = df.select(video.alias("video_id"), index.alias("segment_index"), "embedding", "_file").filter("segment_index IS NOT NULL")
    return x.groupBy("video_id", "segment_index").agg(F.max_by("embedding", "_file").alias("embedding"))


def npz_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """S5 for archives of numpy arrays `segment_keys` and `embeddings`, a file at a time in the workers."""
    import io
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    keys, vectors = z["segment_keys"], z["embeddings"].astype("float32")
                yield pd.DataFrame({"segment_key": [str(k) for k in keys], "embedding": list(vectors), "_file": file})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    x = raw.mapInPandas(load, "segment_key string, embedding array<float>, _file string")
    video, index = split_key(F.col("segment_key"))
    x = x.select(video.alias("video_id"), index.alias("segment_index"), "embedding", "_file").filter("segment_index IS NOT NULL")
    return x.groupBy("video_id", "segment_index").agg(F.max_by("embedding", "_file").alias("embedding"))


def _alternatives(path: str) -> list[str]:
    """A path for each choice of what braces hold."""
    m = re.search(r"\{([^{}]*)\}", path)
    return [q for x in m[1].split(",") for q in _alternatives(path[: m.start()] + x + path[m.end() :])] if m else [path]


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file that the path, which may have wildcards, names, and of those directly in folders that it
    names; what begins with _ or . is passed over. For very many files: tasks list the folders and read the files, and the
    driver knows the path only. Addresses that pyarrow doesn't open are listed and read by Spark."""
    path = re.sub(r"^file:(//)?(?=/)", "", path)  # as a plain path, which may hold spaces
    if "://" not in path:
        path = os.path.abspath(path)
    starts = []
    for one in _alternatives(path):
        parts = one.split("/")
        at = next((k for k, x in enumerate(parts) if re.search(r"[*?\[]", x)), len(parts))
        starts.append(("/".join(parts[:at]), "/".join(parts[at:])))
    try:
        places = [(pafs.FileSystem.from_uri(top)[1], rest) for top, rest in starts]
    except (pa.ArrowInvalid, NotImplementedError):
        return spark.read.format("binaryFile").load(path).select("path", "content")
    ship(spark)
    home = starts[0][0]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One level down: what a folder holds that fits the first part of the rest, or its files if no rest is left."""
        fs, _ = pafs.FileSystem.from_uri(home)
        for b in batches:
            for at, rest, known in zip(*(c.to_pylist() for c in b.columns)):
                found = [(at, rest, True)] if known or not rest and fs.get_file_info(at).type == pafs.FileType.File else None
                if found is None:
                    head, _, tail = rest.partition("/")
                    found = []
                    for e in fs.get_file_info(pafs.FileSelector(at)):
                        is_file = e.type == pafs.FileType.File
                        if e.base_name[0] not in "_." and fnmatch.fnmatchcase(e.base_name, head or "*") and (not tail if is_file else rest):
                            found.append((e.path, tail, is_file))
                for i in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + 4096]), (pa.string(), pa.string(), pa.bool_()))], names=["at", "rest", "known"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(home)
        paths, bodies, size = [], [], 0
        for b in batches:
            for at in b.column(0).to_pylist():
                with fs.open_input_stream(at, compression=None) as f:
                    paths.append(at)
                    bodies.append(f.read())
                size += len(bodies[-1])
                if size >= READ_BYTES or len(paths) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(bodies, pa.binary())], names=["path", "content"])
                    paths, bodies, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(bodies, pa.binary())], names=["path", "content"])

    found = spark.createDataFrame([(at, rest, False) for at, rest in places], "at string, rest string, known boolean").coalesce(1)
    for _ in range(max(len(list(filter(None, rest.split("/")))) for _, rest in places) + 1):
        found = found.mapInArrow(step, "at string, rest string, known boolean").repartition(n, "at")
    return found.select("at").mapInArrow(load, "path string, content binary")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per segment, `.../<video>/..._<index>.json`; damaged files, those of several
    objects among them, and blank texts go."""
    body, ddl = F.col("content").cast("string"), schema.SCHEMAS["transcripts"]
    one = F.from_json(body, f"{ddl}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    x = whole_files(spark, path).select("path", one.alias("x")).filter("x._corrupt IS NULL AND trim(coalesce(x.text, '')) <> ''")
    video = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    index = F.regexp_extract("path", r"(\d+)\.json$", 1).try_cast("int")
    return x.select(video.alias("video_id"), index.alias("segment_index"), "x.text", "x.words")


def captions(spark: SparkSession, path: str) -> DataFrame:
    """Whole caption files; the video's id is the name up to the first dot."""
    return whole_files(spark, path).select(F.regexp_extract("path", r"([^./]+)[^/]*$", 1).alias("video_id"), F.col("content").cast("string").alias("vtt"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(model, metric, value, std) from result files of either shape, one run or aggregated seeds."""
    numbers = "struct<mean: double, std: double>"
    one = ", ".join(f"{m} double" for m in ("auc_roc", "f1"))
    ddl = f"model string, {one}, ndcg_at_k map<string, double>, precision_at_k map<string, double>, recall_at_k map<string, double>, metrics map<string, {numbers}>"
    df = spark.read.schema(ddl).option("multiLine", True).json(path).select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(_test)?(_aggregated)?\.json$", 1).alias("_name"))
    at = lambda kind, k: (F.coalesce(F.col("metrics").getItem(f"{kind}_at_{k}")["mean"], F.col(f"{kind}_at_k").getItem(str(k))), F.col("metrics").getItem(f"{kind}_at_{k}")["std"])
    rows = []
    for k in (3, 5, 10):
        for kind in ("precision", "recall", "ndcg"):
            v, s = at(kind, k)
            rows.append(F.struct(F.lit(f"{kind}_at_{k}").alias("metric"), v.alias("value"), s.alias("std")))
    for m in ("auc_roc", "f1"):
        rows.append(F.struct(F.lit(m).alias("metric"), F.coalesce(F.col("metrics").getItem(m)["mean"], F.col(m)).alias("value"), F.col("metrics").getItem(m)["std"].alias("std")))
    return df.select(F.coalesce("model", "_name").alias("model"), F.explode(F.array(*rows)).alias("x")).select("model", "x.*").filter("value IS NOT NULL")
