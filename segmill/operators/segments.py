"""Features of segments: text, structure, novelty, context, and the tails of external extractors
(A2, A16-A20, A22, F1-F2, F7, F12, F14, F15, J5, J6, W12, W13, W15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segmill import schema
from segmill.functions import scalar, text
from segmill.session import ship


def text_features(segments: DataFrame, text_col: str = "text", duration: str = "duration", words: str | None = None) -> DataFrame:
    """The text features of each segment; those of word times need the array `words`."""
    x = segments.withColumns({"_clean": text.clean_words(F.col(text_col)), "_parts": text.sentences(F.col(text_col))})
    cols = text.text_features(F.col(text_col), F.col(duration), words=F.col("_clean"), parts=F.col("_parts"))
    if words:
        cols |= text.timed_features(F.col(words))
    return x.withColumns(cols).drop("_clean", "_parts")


def last_index(segments: DataFrame, video: str = "video_id", index: str = "segment_index") -> DataFrame:
    """A2: with the largest index of the video, from a partial aggregate joined back."""
    last = segments.groupBy(video).agg(F.max(index).alias("last_index"))
    return segments.join(last, video)


def structural_features(segments: DataFrame) -> DataFrame:
    """F12 and W15 from (video_id, segment_index, start_time, end_time, video_duration)."""
    cols = scalar.structural(F.col("start_time"), F.col("end_time"), F.col("video_duration"), F.col("segment_index"), F.col("last_index"))
    length = cols.pop("video_duration")
    return last_index(segments).withColumns(cols).withColumn("video_duration", length).drop("last_index")


def neighbours(df: DataFrame, column: str, video: str = "video_id", index: str = "segment_index") -> DataFrame:
    """The column of the segments just before and after, null where there is none. Segments are keyed
    by (video, index), so both come from equi-joins, whatever the length of a video."""
    before = df.select(video, (F.col(index) + 1).alias(index), F.col(column).alias("prev"))
    after = df.select(video, (F.col(index) - 1).alias(index), F.col(column).alias("next"))
    return df.join(before, [video, index], "left").join(after, [video, index], "left")


def novelty(df: DataFrame, vector: str = "embedding", video: str = "video_id", index: str = "segment_index") -> DataFrame:
    """one minus the mean cosine with the neighbours there are; 0 without any. One shuffle by video:
    a frame of exactly one index to either side leaves gaps null."""
    w = W.partitionBy(video).orderBy(index)
    a = scalar.cosine(F.col(vector), F.first(vector).over(w.rangeBetween(-1, -1)))
    b = scalar.cosine(F.col(vector), F.first(vector).over(w.rangeBetween(1, 1)))
    x = df.withColumn("_a", a).withColumn("_b", b)
    n = F.when(F.col("_a").isNotNull(), 1).otherwise(0) + F.when(F.col("_b").isNotNull(), 1).otherwise(0)
    mean = (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / n
    return x.withColumn("segment_novelty_to_neighbors", F.when(n > 0, F.round(1.0 - mean, 6)).otherwise(F.lit(0.0))).drop("_a", "_b")


def creator_context(df: DataFrame, category: str = "category") -> DataFrame:
    """F14."""
    return df.withColumns(scalar.one_hot(F.col(category)))


def attach_embeddings(segments: DataFrame, embeddings: DataFrame, size: int) -> DataFrame:
    """Segments with their embedding, zeros where there is none, and a flag for it."""
    e = embeddings.select("video_id", "segment_index", "embedding")
    x = segments.drop("embedding").join(e, ["video_id", "segment_index"], "left").withColumn("has_embedding", F.col("embedding").isNotNull())
    return x.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), size)))


def complete(features: DataFrame, version: str, by: str = "creator_id") -> DataFrame:
    """Missing features become their defaults; a creator with any missing one gets a partial version.
    Columns that aren't there at all are added; others than the schema's go (S11)."""
    have = set(features.columns)
    x = features.withColumns({c: F.lit(None).cast("double") for c in schema.OUTPUT_COLUMNS if c not in have})
    null = F.lit(False)
    for c in schema.FEATURE_COLUMNS:
        null = null | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    partial = x.groupBy(by).agg(F.bool_or(null).alias("_partial"))
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(schema.DEFAULTS.get(c, 0.0))) for c in schema.FEATURE_COLUMNS}
    tag = F.when(F.col("_partial"), f"{version}-partial").otherwise(version)
    return x.join(partial, by).withColumns(filled).withColumn("features_version", tag).select(*schema.OUTPUT_COLUMNS)


# Tails of external extractors. Each works on the array of frame or window values of a segment.


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)).otherwise(F.lit(0.0))


def spread(a: Column) -> Column:
    """Population standard deviation."""
    m = mean(a)
    return F.sqrt(mean(F.transform(a, lambda v: (v - m) * (v - m))))


def arc(a: Column) -> Column:
    """Mean of the last k less the mean of the first k, k = max(1, min(2, n // 3))."""
    n = F.size(a)
    k = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(n / 3).cast("int")))
    return F.when(n > 0, mean(F.slice(a, n - k + 1, k)) - mean(F.slice(a, F.lit(1), k))).otherwise(F.lit(0.0))


def emotion_features(df: DataFrame, arousal: str = "arousal", valence: str = "valence", dominance: str = "dominance") -> DataFrame:
    a, v = F.col(arousal), F.col(valence)
    return df.withColumns(
        {
            "arousal_mean": mean(a), "valence_mean": mean(v), "dominance_mean": mean(F.col(dominance)), "arousal_std": spread(a),
            "arousal_peak": F.coalesce(F.array_max(a), F.lit(0.0)), "arousal_arc_direction": arc(a), "valence_arc_direction": arc(v),
        }
    )


def music_features(df: DataFrame, music: str = "music", instrument: str = "instrument", speech: str = "speech", laughter: str | None = None) -> DataFrame:
    """A17 from arrays of frame scores: mean and share of music, and speech over music, at most 100."""
    m = F.zip_with(F.col(music), F.col(instrument), lambda x, y: x + y)
    cols = {
        "music_presence": mean(m),
        "music_fraction": mean(F.transform(m, lambda x: F.when(x > 0.3, 1.0).otherwise(0.0))),
        "speech_music_ratio": F.least(mean(F.col(speech)) / F.greatest(mean(m), F.lit(0.01)), F.lit(100.0)),
    }
    if laughter:
        cols["laughter_peak"] = F.coalesce(F.array_max(laughter), F.lit(0.0))
    return df.withColumns(cols)


def rising_edges(p: Column, least: float = 0.5) -> Column:
    """How often p goes above `least`; a run that begins with the first frame doesn't count."""
    n = F.size(p)
    later = F.slice(p, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.size(F.filter(F.zip_with(later, F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: (b > least) & (a <= least)), lambda x: x))


def cut_features(df: DataFrame, p: str = "cut_prob", duration: str = "duration") -> DataFrame:
    cuts = rising_edges(F.col(p))
    return df.withColumn("cut_count", cuts.cast("double")).withColumn("cuts_per_second", cuts / F.greatest(F.col(duration), F.lit(1e-6)))


def face_features(df: DataFrame, frames: str = "faces", least: float = 0.5) -> DataFrame:
    """A18 from an array of frames, each an array of faces (score, area_ratio)."""
    sure = F.transform(F.col(frames), lambda f: F.filter(f, lambda x: x["score"] >= least))
    counts = F.array_sort(F.transform(sure, F.size))
    n = F.size(counts)
    areas = F.flatten(F.transform(sure, lambda f: F.transform(f, lambda x: x["area_ratio"])))
    mid = lambda k: F.element_at(counts, k.cast("int")).cast("double")
    median = (mid(F.floor((n + 1) / 2)) + mid(F.floor(n / 2) + 1)) / 2
    return df.withColumns(
        {
            "face_present_ratio": F.when(n > 0, F.size(F.filter(sure, lambda f: F.size(f) > 0)) / n).otherwise(F.lit(0.0)),
            "largest_face_area_ratio_max": F.coalesce(F.array_max(areas), F.lit(0.0)),
            "face_count_median": F.when(n > 0, median).otherwise(F.lit(0.0)),
        }
    )


def mean_pool(frames: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The mean vector of each key."""
    each = frames.select(key, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(key, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def energy_features(df: DataFrame, rms: str = "rms", frames_per_second: str = "fps") -> DataFrame:
    """A22 from an array of RMS values: mean, variance, first three seconds over the mean, and the share
    of frames below a threshold that adapts to the mean."""
    a = F.col(rms)
    m = mean(a)
    first = mean(F.slice(a, F.lit(1), F.greatest(F.least(F.size(a), (F.col(frames_per_second) * 3).cast("int")), F.lit(1))))
    quiet = F.when(m > 0.005, m * 0.1).otherwise(F.lit(0.005))
    return df.withColumns(
        {
            "energy_mean": m,
            "energy_var": spread(a) * spread(a),
            "energy_first_3s_ratio": F.when(m > 0, first / m).otherwise(F.lit(schema.DEFAULTS["energy_first_3s_ratio"])),
            "silence_ratio": mean(F.transform(a, lambda x: F.when(x < quiet, 1.0).otherwise(0.0))),
        }
    )


def colour_features(pixels: DataFrame, segment: str = "segment_id", frame: str = "frame") -> DataFrame:
    """A21 from rows (segment, frame, r, g, b in 0..255): colourfulness by the deviation and mean of the
    opponent colours |r - g| and |(r + g) / 2 - b|, and brightness as the mean of the largest channel,
    each for a frame and then averaged over a segment's frames. Pixels are summed where they lie."""
    rg, yb = F.abs(F.col("r") - F.col("g")), F.abs((F.col("r") + F.col("g")) * 0.5 - F.col("b"))
    norm = lambda f: F.sqrt(f(rg) * f(rg) + f(yb) * f(yb))
    each = pixels.groupBy(segment, frame).agg((norm(F.stddev_pop) + norm(F.avg) * 0.3).alias("c"), (F.avg(F.greatest("r", "g", "b")) / 255.0).alias("v"))
    return each.groupBy(segment).agg(F.avg("c").alias("colorfulness"), F.avg("v").alias("brightness_mean"))


def gated(value: Column, voiced: Column, frames: Column, least_share: float, least_frames: int = 0) -> Column:
    """Pitch and voice values count only with enough voiced frames; what isn't finite is 0."""
    ok = (frames > 0) & (voiced >= frames * least_share) & (voiced >= least_frames)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(ok & finite, value).otherwise(F.lit(0.0))


def hop_windows(samples: Column, size: int, hop: int) -> Column:
    """(start, end) of windows; the whole where there are fewer samples than a window."""
    whole = F.array(F.struct(F.lit(0).alias("start"), samples.cast("int").alias("end")))
    starts = F.sequence(F.lit(0), (samples - size).cast("int"), F.lit(hop))
    return F.when(samples < size, whole).otherwise(F.transform(starts, lambda s: F.struct(s.alias("start"), (s + size).alias("end"))))


def sliding_max(df: DataFrame, value: str, by: str, order: str, following: int = 43) -> DataFrame:
    """W14's tail: the largest value of each row and the `following` rows after it."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(0, following)
    return df.withColumn("window_max", F.max(value).over(w))


def extract(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], ddl: str) -> DataFrame:
    """External extractors: load() makes the model once for each task, and it maps batches of rows."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, ddl)
