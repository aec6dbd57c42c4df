"""Captions: plain text, timed entries and chunks (F3, F4, W10, W11), as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions import scalar, text

TIMES = r"^(\d{2}:\d{2}[\d:.]+)\s*-->\s*(\d{2}:\d{2}[\d:.]+)"
ENTRY = "array<struct<start: double, text: string>>"
CHUNKS = "struct<done: array<struct<start: double, end: double, words: array<string>>>, start: double, words: array<string>>"


def plain_text(vtt: Column) -> Column:
    """the spoken lines without head lines, times and tags; neighbours that are equal count once."""
    lines = F.transform(F.split(F.coalesce(vtt, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    spoken = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|Kind:|Language:|NOTE)") & ~x.rlike(r"^\d{2}:\d{2}"))
    bare = F.filter(F.transform(spoken, lambda x: F.regexp_replace(x, r"<[^>]+>", "")), lambda x: x != "")
    return F.array_join(text.without_repeats(bare), " ")


def timed_entries(vtt: Column) -> Column:
    """(start, text) of each block that has a line of times; the lines after it are its text."""
    blocks = F.split(F.regexp_replace(F.coalesce(vtt, F.lit("")), "\r\n", "\n"), r"\n\n+")

    def entry(block: Column) -> Column:
        return text.let(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), of_lines)

    def of_lines(lines: Column) -> Column:
        # The first line of times, from 1; none is 0.
        at = F.aggregate(
            F.transform(lines, lambda x, i: F.when(x.rlike(TIMES), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.when(a > 0, a).otherwise(b)
        )
        told = F.filter(
            F.transform(F.slice(lines, at + 1, F.size(lines)), lambda x: F.regexp_replace(x, r"<[^>]+>", "")), lambda x: x != ""
        )
        start = scalar.timestamp_seconds(F.regexp_extract(F.element_at(lines, at), TIMES, 1))
        return F.when((at > 0) & (F.size(told) > 0), F.struct(start.alias("start"), F.array_join(told, " ").alias("text")))

    return F.filter(F.transform(blocks, entry), lambda x: x.isNotNull()).cast(ENTRY)


def timed_chunks(entries: Column, seconds: float = 30.0) -> Column:
    """A chunk ends where an entry starts `seconds` or more after the chunk's first one, which then
    starts the next; the last ends `seconds` after the last entry. Repeated words count once."""
    none = F.array().cast("array<string>")
    zero = F.struct(
        F.array().cast("array<struct<start: double, end: double, words: array<string>>>").alias("done"), F.lit(None).cast("double").alias("start"), none.alias("words")
    )

    def step(acc: Column, e: Column) -> Column:
        first = acc["start"].isNull()
        over = ~first & (e["start"] - acc["start"] >= seconds) & (F.size(acc["words"]) > 0)
        closed = F.struct(acc["start"].alias("start"), e["start"].alias("end"), acc["words"].alias("words"))
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(closed))).otherwise(acc["done"]).alias("done"),
            F.when(first | over, e["start"]).otherwise(acc["start"]).alias("start"),
            F.when(over, F.array(e["text"])).otherwise(F.concat(acc["words"], F.array(e["text"]))).alias("words"),
        ).cast(CHUNKS)

    def end(acc: Column) -> Column:
        last = F.struct(acc["start"].alias("start"), (F.element_at(entries, -1)["start"] + seconds).alias("end"), acc["words"].alias("words"))
        chunks = F.when(F.size(acc["words"]) > 0, F.concat(acc["done"], F.array(last))).otherwise(acc["done"])
        return F.transform(
            chunks,
            lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.array_join(text.without_repeats(text.tokens(F.array_join(c["words"], " "))), " ").alias("text")),
        )

    none_at_all = F.array().cast("array<struct<start: double, end: double, text: string>>")
    return F.when(F.size(entries) > 0, F.aggregate(entries, zero.cast(CHUNKS), step, end)).otherwise(none_at_all)


def parse_captions(df: DataFrame, vtt: str = "vtt") -> DataFrame:
    """Captions with text, entries and chunks; a caption that is null has none."""
    return df.withColumn("text", plain_text(F.col(vtt))).withColumn("entries", timed_entries(F.col(vtt))).withColumn("chunks", timed_chunks(F.col("entries")))
