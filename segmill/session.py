"""Session helpers: shipping the package to Python workers, and the shared folder."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def build_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as the tests and the bench use it."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make the package importable in every Python worker, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_segmill_shipped", False):
        return
    files = sorted(p for p in ROOT.rglob("*.py"))
    tag = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    target = Path(tempfile.mkdtemp(prefix="segmill-")) / f"segmill-{tag}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in files:
            z.write(p, p.relative_to(ROOT.parent).as_posix())
    sc.addPyFile(str(target))
    sc._segmill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors see, below spark.checkpoint.dir.

    Only where that setting is absent (tests, one machine) a temporary folder stands in.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(sc, "_segmill_shared", None)
        if base is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
            base = "file://" + tempfile.mkdtemp(prefix="segmill-shared-")
            sc._segmill_shared = base
            sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/segmill-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def remove_shared() -> None:
    """Delete the folders that shared_dir() gave out; they live as long as the program."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the gateway may be gone at exit
            if path.startswith("file://") and os.path.isdir(path[7:]):
                import shutil

                shutil.rmtree(path[7:], ignore_errors=True)


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage with a table in the shared folder: written once, read by what follows.

    Unlike a local checkpoint it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, *by: str, parts: int = 0) -> DataFrame:
    """The rows dealt out by the hash of these columns, and sorted by them, over as many tasks as there are cores, or `parts`
    if that is more.

    For rows that cost far more than their bytes tell: adaptive execution merges small partitions, and a table
    written from one partition is read by one task ever after.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, parts)
    return df.repartition(n, *by).sortWithinPartitions(*by)


def parts_of(table: DataFrame, each: int = 8) -> int:
    """A number of shuffle partitions that grows with a stored table: `each` for every split of its scan, and no fewer than
    there are cores. The set number stays the same however many rows there are, and a task's memory grows with them."""
    return max(table.sparkSession.sparkContext.defaultParallelism, each * table.rdd.getNumPartitions())
