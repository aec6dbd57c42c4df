"""Writers (S11-S13, S15, S16)."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence
from string import Formatter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill import schema
from segmill.operators.discovery import in_order, numbered
from segmill.session import ship
from segmill.sources.named import NamedFiles


def ordered(df: DataFrame, columns: list[str] = schema.OUTPUT_COLUMNS) -> DataFrame:
    """The schema's columns in its order; missing ones are null, others go."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def by_creator(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Partitioned by creator; rows meet by creator first, so that each has few files."""
    out = df.repartition("creator_id").write.partitionBy("creator_id").mode("overwrite")
    (out.option("header", True).csv(path) if fmt == "csv" else out.parquet(path))


def embeddings(df: DataFrame, path: str) -> None:
    """Sorted by (video, index) within files."""
    key = F.concat_ws("|", "video_id", F.col("segment_index").cast("string"))
    df.select("video_id", "segment_index", key.alias("segment_key"), "embedding").repartition("video_id").sortWithinPartitions("video_id", "segment_index").select(
        "segment_key", "embedding"
    ).write.mode("overwrite").parquet(path)


def embedding_archives(df: DataFrame, path: str, by: str = "video_id", index: str = "segment_index", vector: str = "embedding") -> int:
    """S12 as numpy archives, one a video, with `segment_keys` (video|index) and `embeddings`; their number.
    Tasks write under a name that readers pass over and move the file when it is complete."""
    ship(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(path)
        fs.create_dir(top)
        files, held = 0, []

        def close() -> None:
            nonlocal files, held
            if held:
                name = str(held[0][0])
                own = f"{top}/_{uuid.uuid4().hex}-{name}.npz"
                with fs.open_output_stream(own) as out:
                    body = io.BytesIO()
                    np.savez(body, segment_keys=np.array([f"{v}|{k}" for v, k, _ in held]), embeddings=np.array([e for _, _, e in held], np.float32))
                    out.write(body.getvalue())
                fs.move(own, f"{top}/{name}.npz")
                files, held = files + 1, []

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(by).cast("string").alias("v"), F.col(index).cast("long").alias("k"), vector).filter(F.col(vector).isNotNull())
    return rows.repartition(n, "v").sortWithinPartitions("v", "k").mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


def matrix(df: DataFrame, path: str) -> None:
    """Keys and the features that are there, partitioned by split."""
    keep = [c for c in [*schema.KEY_COLUMNS, "label", "split", *schema.FEATURE_COLUMNS] if c in df.columns]
    df.select(*keep).write.partitionBy("split").mode("overwrite").parquet(path)


def results_json(df: DataFrame, path: str) -> None:
    """S15."""
    df.write.mode("overwrite").json(path)


def _named(template: str) -> Column:
    """The template with the columns in braces filled in."""
    parts = []
    for text, column, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] * bool(text) + ([F.col(column).cast("string")] if column else [])
    return F.concat(*parts)


def named_files(df: DataFrame, path: str, by: list[str], name: str, fmt: str = "csv", header: bool = False, **options: str) -> None:
    """One file for each value of `by`, named by the template (for instance "{creator_id}_pairs.csv"),
    whose columns aren't repeated in the file. Values must be fit for names; rows with a null one go to no
    file. Lines are made by Spark as its own writers make them; the tasks write and name the files, each
    file in one task."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(NamedFiles)
    own = [c for c in df.columns if c not in by]
    lines = {"csv": lambda: F.to_csv(F.struct(*own), options), "json": lambda: F.to_json(F.struct(*own), options), "text": lambda: F.col(own[0])}
    first = df.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(c) for c in own]), options)).first()[0] if header else ""
    rows = df.select(_named(name).alias("name"), lines[fmt]().alias("line")).filter(F.col("name").isNotNull())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "name").write.format("named_files").option("path", path).option("header", first).mode("append").save()


def report(df: DataFrame, order: list[Column], digits: int = 4, hide: Sequence[str] = ()) -> DataFrame:
    """A report table in Markdown as rows (number, line), the heading first; numbers have `digits`
    places and null is blank. All rows are there, without the columns to hide."""
    names = [c for c in df.columns if c not in hide]
    kinds = dict(df.dtypes)
    show = lambda c: F.format_string(f"%.{digits}f", F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.when(F.col(c).isNull(), "").otherwise(show(c)) for c in names]), F.lit(" |"))
    body = numbered(in_order(df.orderBy(*order).select(cells.alias("line")))).select(F.col("position").cast("int").alias("number"), "line")
    head = [(-1, "| " + " | ".join(names) + " |"), (0, "|" + "---|" * len(names))]
    return df.sparkSession.createDataFrame(head, "number int, line string").union(body)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small report table as text, rows as they come, all of them."""
    names = df.columns
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in df.collect()])
