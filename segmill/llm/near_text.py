"""SimHash near-dedup whose links are confirmed on the texts.

Fingerprints of the distinct words find candidates: they change little where a few words do. What the
tiled comparison links makes clusters, and within these the full sets of 5-word shingles decide, as
for HyperMinHash. So a wider radius finds more near copies and drops no document that isn't one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common, minhash, simhash
from segmill.llm.components import components
from segmill.session import materialize

SHINGLE = 5
RADIUS = 7


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, percent: float = minhash.PERCENT) -> DataFrame:
    """doc_id and group of the rows that have a near copy; group is the smallest doc_id of those that links
    connect. doc_id must tell rows apart.

    Links join texts whose fingerprints of distinct words differ in `radius` bits at most and whose sets of
    shingles share `percent` hundredths of their union; texts of fewer words are one shingle. Rows without
    a word, null texts among them, and rows without a near copy aren't there; an empty table gives an empty
    result; other columns are ignored.
    """
    fps = materialize(simhash.fingerprints(df, id_col, text_col, 1, distinct=True).select("doc_id", "fp"))
    # Rows of one fingerprint are counted in salted parts; fingerprints are the nodes of the clusters.
    sized = common.with_least(fps, ["fp"], "doc_id", "doc_id").withColumnRenamed("members", "same")
    nodes = materialize(fps.select("fp").distinct())
    found = components(simhash.links(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    linked = sized.join(common.sorted_join(found.withColumnRenamed("node", "fp")), "fp", "left").filter(F.col("component").isNotNull() | (F.col("same") > 1))
    clusters = materialize(linked.select(F.col("doc_id").alias("node"), F.coalesce("component", "fp").alias("component")))
    texts = common.pick(df, doc_id=id_col, text=text_col).join(common.sorted_join(clusters.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    sigs = minhash.signatures(texts, shingle=shingle).filter("n > 0").withColumn("row", F.col("doc_id"))
    sigs = materialize(sigs)
    named = minhash.confirm(clusters, sigs, percent, shingle)
    return common.with_least(named, ["label"], "node", "node").filter("members > 1").select(F.col("node").alias("doc_id"), F.col("least").alias("group"))
