"""Linking shorts to longs and to segments by fuzzy text.

Scores come from an Arrow UDF after an equi-join on the creator (or on the long that captions
matched), never from a cross join. The UDF scores a batch of pairs together and leaves out, without
loss, what bounds on the LCS exclude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segmill import schema
from segmill.functions.similarity import partial_ratio_from_udf, partial_ratio_udf
from segmill.functions.text import let, tokens
from segmill.session import materialize, ship


def window_chunks(text: Column, size: int = schema.WINDOW_CHARS, step: int = schema.WINDOW_STEP, whole: int = schema.WHOLE_CHARS) -> Column:
    """The windows that W6 compares: one for texts up to `whole`, else one at every `step`."""
    n = F.length(text)
    starts = F.when(n <= whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.when(n <= whole, n).otherwise(F.lit(size))).alias("text")))


def early_exit_score(windows: DataFrame, keys: list[str], least: float = schema.MATCH_SCORE) -> DataFrame:
    """W6 over rows (keys, start, score): the first score of at least `least`, else the largest."""
    hit = F.col("score") >= least
    first = F.min_by(F.when(hit, F.col("score")), F.when(hit, F.col("start")))
    return windows.groupBy(*keys).agg(F.coalesce(first, F.max("score"), F.lit(0.0)).alias("score"))


def may_match(short: Column, long: Column, least: float = schema.MATCH_SCORE) -> Column:
    """False only for pairs that can't score `least`: too few of the short's bigrams are in the long.

    A score of r against a window w means at most (1 - r)(|s| + |w|) <= 2 (1 - r) |s| edits, each of
    which destroys at most two of the short's |s| - 1 bigrams.
    """

    def test(t: Column, u: Column) -> Column:
        n = F.length(t)
        spots = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        found = F.size(F.filter(spots, lambda g: F.contains(u, g)))
        lost = 2 * F.floor(F.lit(2 * (1 - least / 100)) * n + 1e-9)
        return (found >= n - 1 - lost) | (F.length(u) < n)

    return let(F.lower(short), lambda t: let(F.lower(long), lambda u: test(t, u)))


#: Characters by which shorts of up to two tokens are looked for.
GRAM = 12


def contains_match(short: DataFrame, long: DataFrame, words: int = 8) -> DataFrame:
    """Exact case of J8: (short_id, long_id) where the short's text is part of the long's.

    An equi-join on the hash of the short's inner tokens among its first `words` finds candidates among
    the long's runs of as many tokens (the outermost may be cut by what surrounds the passage). Shorts
    of up to two tokens have no inner ones: their first GRAM characters are looked for among the long's
    runs of as many characters, which are made only for the lengths that occur. An empty short is part
    of every text.
    """
    s = short.filter(F.col("text").isNotNull()).select("short_id", F.col("text").alias("short_text"), F.slice(tokens(F.col("text")), 1, words).alias("head"))
    # k is the number of inner tokens, or -1 less the number of characters.
    s = s.withColumn("k", F.when(F.size("head") > 2, F.size("head") - 2).otherwise(-1 - F.least(F.length("short_text"), F.lit(GRAM))))
    sizes = sorted(r["k"] for r in s.select("k").distinct().collect())  # at most `words` - 2 and GRAM + 1 numbers
    part = F.when(F.col("k") > 0, F.array_join(F.expr("slice(head, 2, greatest(k, 0))"), " ")).otherwise(F.expr("substring(short_text, 1, greatest(-1 - k, 0))"))
    keyed = s.select("short_id", "short_text", F.xxhash64(F.col("k"), part).alias("h"))

    def runs(t: Column, n: Column, k: int, cut) -> Column:
        """Hashes of all runs of |k| of the n parts of t."""
        size = k if k > 0 else -1 - k
        if not size:
            return F.array(F.xxhash64(F.lit(k), F.lit("")))
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.lit(k), cut(t, i, size)))).otherwise(F.array().cast("array<bigint>"))

    def hashes(t: Column) -> Column:
        none = F.array().cast("array<bigint>")
        by_token = [runs(t, F.size(t), k, lambda x, i, n: F.array_join(F.slice(x, i, F.lit(n)), " ")) for k in sizes if k > 0]
        by_char = [runs(F.col("text"), F.length("text"), k, lambda x, i, n: F.substring(x, i, F.lit(n))) for k in sizes if k < 0]
        return F.array_distinct(F.concat(none, *by_token, *by_char))

    known = keyed.select("h").distinct()
    long = long.filter(F.col("text").isNotNull())
    places = long.select("long_id", F.explode(let(tokens(F.col("text")), hashes)).alias("h")).join(known, "h", "left_semi")
    near = keyed.join(places, "h").select("short_id", "short_text", "long_id").distinct()
    found = near.join(long.select("long_id", F.col("text").alias("long_text")), "long_id")
    return found.filter(F.contains(F.col("long_text"), F.col("short_text"))).select("short_id", "long_id").distinct()


#: Pairs of a creator's shorts and windows that one task scores.
PAIRS = 4096


def creator_pairs(shorts: DataFrame, windows: DataFrame, by: str, pairs: int | None = None) -> DataFrame:
    """All pairs of a short with a window of the same creator.

    A creator with more than `pairs` (PAIRS) of them has its shorts dealt out over as many parts as that takes,
    each of which meets all its windows, so no task scores a hot creator alone.
    """
    n_s, n_w = shorts.groupBy(by).agg(F.count(F.lit(1)).alias("_a")), windows.groupBy(by).agg(F.count(F.lit(1)).alias("_b"))
    cuts = n_s.join(n_w, by).select(by, F.ceil(F.col("_a") * F.col("_b") / F.lit(float(pairs or PAIRS))).alias("_cuts"))
    s = shorts.join(cuts, by).withColumn("_part", F.pmod(F.xxhash64("short_id"), F.col("_cuts"))).drop("_cuts")
    w = windows.join(cuts, by).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1))).drop("_cuts")
    # Scoring costs far more than the bytes tell, so small partitions are not to be merged.
    n = int(shorts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return s.repartition(n, by, "_part").join(w.repartition(n, by, "_part"), [by, "_part"]).drop("_part")


def caption_scores(shorts: DataFrame, longs: DataFrame, by: str = "creator_id", least: float = schema.MATCH_SCORE) -> DataFrame:
    """(by, short_id, long_id, short_pos, long_pos, score) of all pairs of a creator that reach `least`.

    Each window of a long is scored on its own, exactly if it reaches `least`; the first one that does
    gives the pair's score. Shorts below 20 characters and longs up to 100 take no part.
    """
    ship(shorts.sparkSession)
    s = shorts.filter(F.length("text") >= 20).select(by, "short_id", F.lower("text").alias("_s"), F.col("pos").alias("short_pos"))
    t = longs.filter(F.length("text") > 100).select(by, "long_id", F.lower("text").alias("_t"), F.col("pos").alias("long_pos"))
    w = t.select(by, "long_id", "long_pos", F.explode(window_chunks(F.col("_t"))).alias("_w")).select(by, "long_id", "long_pos", F.col("_w.start").alias("_start"), F.col("_w.text").alias("_w"))
    scored = creator_pairs(s, w, by).withColumn("score", partial_ratio_udf(least)(F.col("_s"), F.col("_w"))).filter(F.col("score") >= least)
    return scored.groupBy(by, "short_id", "long_id", "short_pos", "long_pos").agg(F.min_by("score", "_start").alias("score"))


#: More turns than any input needs whose shorts compete for fewer longs than this.
ASSIGN_TURNS = 1000


def greedy_assign(scores: DataFrame, by: str = "creator_id", capacity: int = schema.MAX_PAIRS_PER_LONG, least: float = schema.MATCH_SCORE) -> DataFrame:
    """Shorts in list order each take the best long that has fewer than `capacity` pairs; of equal
    scores the first long. A short that reaches no long takes nothing.

    All longs prefer earlier shorts, so what the walk through the list gives is the one stable matching,
    which proposals in turns give as well: each short asks the best long that may still take it, a long
    keeps the first `capacity` of those that ask, and once it is full, later shorts than its last one ask
    it no more. Each turn is a join, a minimum a short and a limited rank a long, so no creator is walked
    in one task; a long's limit is written to the shared folder from turn to turn.
    """
    first = F.struct("short_pos", "short_id")
    want = F.struct(-F.col("score"), F.col("long_pos"), F.col("long_id"))
    asks = materialize(scores.filter(F.col("score") >= least).select(F.col(by).alias("_by"), "short_id", "long_id", "score", first.alias("_first"), want.alias("_want")))
    limits, before = None, None
    for _ in range(ASSIGN_TURNS):
        open_ = asks
        if limits is not None:
            full = limits.select(F.col("_by").alias("_of"), F.col("long_id").alias("_full"), "_last")
            open_ = asks.join(full, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("long_id") == F.col("_full")), "left").filter(F.col("_last").isNull() | (F.col("_first") <= F.col("_last")))
        asked = open_.groupBy("_by", "_first").agg(F.min_by(F.struct("short_id", "long_id", "score"), "_want").alias("x")).select("_by", "_first", "x.*")
        rank = F.row_number().over(W.partitionBy("_by", "long_id").orderBy("_first"))
        held = asked.withColumn("_rank", rank).filter(F.col("_rank") <= capacity)
        new = materialize(held)
        limits = new.filter(F.col("_rank") == capacity).select("_by", "long_id", F.col("_first").alias("_last"))
        now = limits.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_by", "long_id", "_last").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return new.select(F.col("_by").alias(by), "short_id", "long_id", F.round("score", 1).alias("caption_score"))
        before = now
    raise RuntimeError(f"assignment did not settle in {ASSIGN_TURNS} turns")


def locate(pairs: DataFrame, shorts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Approximate place of a pair: the first chunk (long_id, start, end, text) with the highest score."""
    ship(pairs.sparkSession)
    x = pairs.join(shorts.select("short_id", F.col("text").alias("_s")), "short_id").join(chunks, "long_id")
    x = x.withColumn("_score", partial_ratio_udf()(F.col("_s"), F.col("text")))
    best = F.max_by(F.struct("start", "end"), F.struct(F.col("_score"), -F.col("start")))
    hit = x.groupBy("short_id", "long_id").agg(best.alias("x"))
    return pairs.join(hit, ["short_id", "long_id"], "left").select(
        *pairs.columns, F.coalesce("x.start", F.lit(0.0)).alias("approx_start"), F.coalesce("x.end", F.lit(0.0)).alias("approx_end")
    )


def with_next(segments: DataFrame) -> DataFrame:
    """Text of the segment whose index is one more, null where there is a gap. Segments are keyed by
    (video_id, segment_index), so this is an equi-join."""
    nxt = segments.select("video_id", (F.col("segment_index") - 1).alias("segment_index"), F.col("text").alias("next_text"))
    return segments.join(nxt, ["video_id", "segment_index"], "left")


def segment_scores(pairs: DataFrame, shorts: DataFrame, segments: DataFrame, least: float = schema.MATCH_SCORE, least_words: int = 10) -> DataFrame:
    """For each pair the best score of each segment of its long.

    Two segments that follow each other are also compared as one text, which counts for the better of
    the two; a single match wins over a combined one of the same score. Shorts of fewer than `least_words`
    words take no part; with 0 even empty ones do, which match empty segments only.
    """
    ship(pairs.sparkSession)
    s = shorts.filter(F.size(tokens(F.col("text"))) >= least_words).select("short_id", F.col("text").alias("_s"))
    seg = with_next(segments).select(F.col("video_id").alias("long_id"), "segment_index", "text", "next_text")
    x = pairs.select("short_id", "long_id").join(s, "short_id").join(seg, "long_id")
    # First only whether the score is reached, which prunes most windows; the exact score of a side only
    # where both reach it, and the later side's only if it may be the better one. A UDF runs on all rows
    # even within when(), so what isn't needed is passed as null.
    reached, exact, exact_from = partial_ratio_udf(least), partial_ratio_udf(), partial_ratio_from_udf()
    pair = F.when(F.col("next_text").isNotNull(), F.concat_ws(" ", "text", "next_text"))
    empty = (F.col("_s") == "") & (F.col("text") == "")
    x = x.withColumn("own", F.when(empty, 100.0).otherwise(reached(F.col("_s"), F.col("text")))).withColumn("both", reached(F.col("_s"), pair))
    x = x.filter((F.col("own") >= least) | (F.col("both") >= least))
    spans = F.col("both") >= least
    x = x.withColumn("left", F.greatest(F.col("own"), exact(F.when(spans & (F.col("own") < least), F.col("_s")), F.col("text"))))
    x = x.withColumn("after", exact_from(F.when(spans, F.col("_s")), F.col("next_text"), F.col("left")))
    single = x.filter(F.col("own") >= least).select("short_id", "long_id", "segment_index", F.col("own").alias("score"), F.lit("single").alias("method"), F.lit(-1).alias("_at"))
    combined = x.filter(F.col("both") >= least).select(
        "short_id", "long_id", F.when(F.col("left") >= F.col("after"), F.col("segment_index")).otherwise(F.col("segment_index") + 1).alias("segment_index"),
        F.col("both").alias("score"), F.lit("combined").alias("method"), F.col("segment_index").alias("_at"),
    )
    return best_per_segment(single.union(combined))


def best_per_segment(matches: DataFrame) -> DataFrame:
    """W3."""
    top = F.max_by("method", F.struct(F.col("score"), (F.col("method") == "single").cast("int"), -F.col("_at")))
    return matches.groupBy("short_id", "long_id", "segment_index").agg(F.max("score").alias("score"), top.alias("method"))


def best_per_short(matches: DataFrame, prefer: str | None = None) -> DataFrame:
    """The segment with the highest score, the lowest index of equal ones. Where `prefer` names a column,
    its largest value goes before the index."""
    first = [F.col("score"), *([F.col(prefer)] if prefer else []), -F.col("segment_index")]
    top = F.max_by(F.struct("long_id", "segment_index", "score", "method"), F.struct(*first))
    return matches.groupBy("short_id").agg(top.alias("x")).select(
        "short_id", "x.long_id", F.col("x.segment_index").alias("matched_segment_index"), F.round("x.score", 1).alias("match_score"),
        F.col("x.method").alias("match_method"), F.when(F.col("x.score") >= schema.HIGH_SCORE, "very_high").otherwise("high").alias("match_confidence"),
    )


def matched_ids(pairs: DataFrame, column: str) -> DataFrame:
    """U2."""
    return pairs.select(column).distinct()


