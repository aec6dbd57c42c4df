"""Splits without leakage and their counts."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill import schema
from segmill.session import materialize


def hash_bucket(group: Column, buckets: int = 100) -> Column:
    """A number below `buckets` from the md5 of the group's id."""
    return F.pmod(F.conv(F.substring(F.md5(group.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def split_of(group: Column, shares: dict[str, int] = schema.SPLITS) -> Column:
    """L1: the split that the hash of the group's id falls into, in the order of the shares."""
    b, below, out = hash_bucket(group), 0, F.when(F.lit(False), "")
    names = list(shares)
    for name in names[:-1]:
        below += shares[name]
        out = out.when(b < below, name)
    return out.otherwise(names[-1])


def group_split(df: DataFrame, group: str = "video_id", shares: dict[str, int] = schema.SPLITS) -> DataFrame:
    """L1: all rows of a group are in one split, by a function of the id alone: no shuffle, no state."""
    return df.withColumn("split", split_of(F.col(group), shares))


def split_counts(groups: int, shares: dict[str, int] = schema.SPLITS) -> dict[str, int]:
    """How many groups the two-pass holdout gives: the held-out part rounded up, then its test part too."""
    names, total = list(shares), sum(shares.values())
    held = math.ceil(groups * (total - shares[names[0]]) / total)
    test = math.ceil(held * shares[names[2]] / (shares[names[1]] + shares[names[2]]))
    return {names[0]: groups - held, names[1]: held - test, names[2]: test}


#: Bits of the hash by which groups are put in order, and how many of them a count refines.
HASH_BITS, STEP_BITS = 60, 12


def group_hash(group: Column, seed: int) -> Column:
    """A whole number of HASH_BITS bits from the md5 of the seed and the group's id."""
    text = F.concat(F.lit(f"{seed}:"), group.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def nth_smallest(values: DataFrame, column: str, ns: list[int]) -> list[int]:
    """The value below which exactly n of the distinct whole numbers of HASH_BITS bits lie, for each n.

    Numbers are counted by their first bits, then those of the cell that holds the n-th by further
    bits, until a cell is one number: a few counts of at most 4,096 cells, whatever the number of rows.
    """
    out = []
    for n in ns:
        shift, low, rest = HASH_BITS, 0, n
        while shift:
            shift -= STEP_BITS
            some = values.filter((F.col(column) >= low) & (F.col(column) < low + (1 << (shift + STEP_BITS))))
            cells = some.groupBy(F.shiftright(column, shift).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect()
            for r in cells:
                if rest < r["n"]:
                    break
                rest -= r["n"]
            else:  # all of them are below
                low, shift = low + (1 << (shift + STEP_BITS)), 0
                break
            low = r["c"] << shift
        out.append(low)
    return out


def exact_group_split(df: DataFrame, group: str = "video_id", seed: int = 42, shares: dict[str, int] = schema.SPLITS) -> DataFrame:
    """L1 with exactly the numbers of groups of split_counts: groups in the order of a hash of seed and id.

    Where the splits end is found by counts over the distinct groups, written once; rows get their split
    by comparing their hash with two numbers, so no id is collected and nothing is joined. Rows whose
    group is null have no split.
    """
    own = group_hash(F.col(group), seed)
    ids = materialize(df.filter(F.col(group).isNotNull()).select(own.alias("h")).distinct())
    sizes = split_counts(ids.count(), shares)
    names = list(sizes)
    ends = nth_smallest(ids, "h", list(accumulate(sizes.values()))[:-1])
    split = F.when(own < ends[0], names[0]).when(own < ends[1], names[1]).when(own.isNotNull(), names[2])
    return df.withColumn("split", split)


def counts(df: DataFrame, group: str = "video_id") -> DataFrame:
    """A5."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"), F.sum("label").alias("positives"),
        F.round(100.0 * F.sum("label") / n, 4).alias("pct"),
    )


def pivot(df: DataFrame, by: str = "category", splits: list[str] | None = None) -> DataFrame:
    """A4: sums of labels by category and split, 0 where there are none."""
    names = splits or list(schema.SPLITS)
    return df.groupBy(by).pivot("split", names).agg(F.sum("label")).na.fill(0, names)


def leaks(df: DataFrame, group: str = "video_id") -> DataFrame:
    """Groups with rows in several splits."""
    return df.groupBy(group).agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


def check_no_leak(df: DataFrame, group: str = "video_id") -> DataFrame:
    bad = leaks(df, group).take(5)
    if bad:
        raise ValueError(f"groups in several splits: {[r[group] for r in bad]}")
    return df


def load_split(df: DataFrame, split: str, columns: list[str] | None = None) -> DataFrame:
    """Keys, label and features of one split, features as float; only these columns are read."""
    columns = columns or schema.FEATURE_COLUMNS
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    keys = [c for c in (*schema.KEY_COLUMNS, "label", "split") if c in df.columns]
    return df.filter(F.col("split") == split).select(*keys, *[F.col(c).cast("float") for c in columns])


def feature_subset(df: DataFrame, groups: list[str]) -> DataFrame:
    """Keys and the features of these groups, in the schema's order."""
    schema.check_groups()
    wanted = {c for g in groups for c in schema.GROUPS[g]}
    keys = [c for c in (*schema.KEY_COLUMNS, "label", "split") if c in df.columns]
    return df.select(*keys, *[c for c in schema.FEATURE_COLUMNS if c in wanted])


def with_transcripts(splits: DataFrame, transcripts: DataFrame, key: str = "segment_id") -> DataFrame:
    """Left join; a missing text is ''."""
    t = transcripts.select(key, F.col("text").alias("_text"))
    return splits.join(t, key, "left").withColumn("text", F.coalesce("_text", F.lit(""))).drop("_text")


def in_fraction(fraction: float, group: str = "video_id", seed: int = 42) -> Column:
    """Whether a group is in a share of the groups; larger shares contain the smaller ones."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(10_000)) < int(fraction * 10_000)


def fraction_of_groups(df: DataFrame, fraction: float, group: str = "video_id", seed: int = 42) -> DataFrame:
    """The training rows of a share of the groups."""
    return df.filter(in_fraction(fraction, group, seed))
