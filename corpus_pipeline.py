"""The corpus pipeline: language ID, quality, exact dedup, SimHash near-dedup, packing.

Each stage gets the documents that its predecessor kept and, but for the last, returns them with the
columns of `documents`. run() writes each stage's result as Parquet to the shared folder and reads it
again for the next, so a stage that loses executors repeats no earlier one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import common, exact_dedup, language_id, near_text, packing, quality, queries
from segmill.session import materialize, shared_dir

#: A document goes if it has no letter, or if its likeliest language is less likely than all others together.
LEAST_LANGUAGE = 0.5
#: A document goes if it is more likely bad than good.
LEAST_QUALITY = 0.5
#: Documents are near copy candidates if the fingerprints of their distinct words differ in so many bits of
#: 64 at most; their sets of 5-word shingles decide.
NEAR_BITS = 7


def _new_name(docs: DataFrame, name: str) -> str:
    """A name that no column has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _only(docs: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """The rows with these keys, or with others, with the columns of the documents."""
    kept = keys.select(F.col(keys.columns[0]).alias(other := _new_name(docs, "other_key"))).distinct()
    return docs.join(common.sorted_join(kept), F.col(key).eqNullSafe(F.col(other)), how).drop(key)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return language_id.keep_languages(docs, LEAST_LANGUAGE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough."""
    return quality.keep_quality(docs, queries.table(spark, sf_dir, "labels"), LEAST_QUALITY)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a key of their own, in the order of doc_id, nulls last, and the key's name. A doc_id that no
    row repeats or lacks is the key; else rows are numbered, and written so that verdicts and rows come from
    one numbering."""
    key = _new_name(docs, "row_key")
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not counts.filter("n > 1 OR doc_id IS NULL").head(1):
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    at = docs.withColumn(key, F.monotonically_increasing_id())  # parts a repeated doc_id among tasks
    return materialize(at.orderBy(F.col("doc_id").asc_nulls_last(), key).withColumn(key, F.monotonically_increasing_id())), key


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    docs, key = _keyed(docs)
    return _only(docs, exact_dedup.exact_dedup(docs, key).filter("kept").select("doc_id"), key, "left_semi")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    docs, key = _keyed(docs)
    found = near_text.near_groups(docs, key, radius=NEAR_BITS)
    return _only(docs, found.filter(F.col("doc_id") != F.col("group")).select("doc_id"), key, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences."""
    return packing.pack_documents(docs, queries.tokenizer(queries.WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again.

    No stage tells rows by doc_id alone: rows without one or with a repeated one are judged by their own
    texts, so only texts that the stages reject or that have a copy go. Null texts have no letter and go
    in the first stage; an empty table gives an empty result; other columns are carried to the last stage.
    """
    docs = queries.table(spark, sf_dir, "documents")
    out = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
