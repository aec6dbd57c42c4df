"""Token counts by two tiers at the map side: a broadcast table of frequent pre-tokens, then caches.

The table (vocab.Lengths) has the number of tokens of each frequent pre-token and is probed in place
for a batch's distinct pre-tokens at once. It is fitted on a sample that is bounded in rows and bytes
and only saves time: what it lacks is encoded by the worker and kept in its store, so counts are
exact whatever the table holds. No pre-token is shuffled; the sampled texts go to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common, vocab
from segmill.session import ship

#: Entries of the broadcast table; the rows that fit it, and their most bytes: 2 x 2,000 x 8 KB reach the driver at most.
TABLE = 32_768
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 8 << 10
LONGEST = 64


def frequent(df: DataFrame, text: str, path: str, table: int, sample: int) -> vocab.Lengths:
    """The most frequent pre-tokens of about `sample` rows of at most SAMPLE_BYTES."""
    some = df.filter(F.octet_length(text).between(1, SAMPLE_BYTES)).select(text)
    n = some.count()
    share = min(1.0, sample / n) if n else 1.0
    words = vocab.word_tokens(path)
    count: Counter[bytes] = Counter()
    for r in some.sample(False, share, seed=7).limit(2 * sample).collect():
        for w, k in words.pre_tokens(r[0]).items():
            if len(w) <= LONGEST:
                count[w] += k
    top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:table]]
    return vocab.Lengths(words.lengths(top))


def count_tokens(
    df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE, sample: int = SAMPLE_ROWS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows; an empty table
    gives an empty result; other columns are ignored. Words of any length are encoded whole.
    """
    spark = df.sparkSession
    ship(spark)
    src = common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    known = spark.sparkContext.broadcast(frequent(src, "text", path, table, sample))  # at most TABLE x LONGEST bytes and 16 each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, words = known.value, vocab.word_tokens(path)
        for ids, n_bytes, texts in common.by_bytes(batches, 2):
            tokens = words.count(texts, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([n or 0 for n in n_bytes], pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
