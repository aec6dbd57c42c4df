"""Scalar functions of time, position, engagement and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmill import schema


def iso_seconds(duration: Column) -> Column:
    """`PT#H#M#S` as seconds; anything else, days included, is 0."""
    shape = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
    part = lambda k: F.coalesce(F.regexp_extract(duration, shape, k).try_cast("int"), F.lit(0))
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0))


def timestamp_seconds(text: Column) -> Column:
    """`H:M:S.mmm` or `M:S.mmm` as seconds, a comma counting as point; other shapes are 0."""
    parts = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")
    at = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("double"), F.lit(0.0))
    return (
        F.when(F.size(parts) == 3, at(1) * 3600 + at(2) * 60 + at(3)).when(F.size(parts) == 2, at(1) * 60 + at(2)).otherwise(F.lit(0.0))
    )


def age_seconds(published: Column, as_of: Column) -> Column:
    return F.unix_timestamp(as_of) - F.unix_timestamp(published)


def days_live(published: Column, as_of: Column) -> Column:
    """whole days, 1 at least (not calendar days)."""
    return F.greatest(F.floor(age_seconds(published, as_of) / 86400), F.lit(1)).cast("int")


def too_recent(published: Column, as_of: Column, days: int = schema.MIN_AGE_DAYS) -> Column:
    """younger than so many days; just as old isn't."""
    return age_seconds(published, as_of) < days * 86400


def stale(heartbeat: Column, now: Column, ttl: float = 7200.0) -> Column:
    """F19."""
    return (now - heartbeat) > ttl


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def engagement_rate(likes: Column, comments: Column, views: Column, comments_disabled: Column) -> Column:
    """F20."""
    return F.round(safe_ratio(F.when(comments_disabled, likes).otherwise(likes + comments), views), 6)


def views_per_day(views: Column, days: Column) -> Column:
    return F.round(safe_ratio(views, days), 1)


def exceeds(value: Column, median: Column, times: float) -> Column:
    """One half of F21: strictly more than so many medians; never for a median that isn't positive."""
    return F.coalesce((median > 0) & (value > F.lit(float(times)) * median), F.lit(False))


def confidence(score: Column, high: float = schema.HIGH_SCORE) -> Column:
    """F22."""
    return F.when(score >= high, "very_high").otherwise("high")


def position(start: Column, duration: Column) -> Column:
    """F12, not rounded."""
    return start / F.greatest(duration.cast("double"), F.lit(1e-6))


def structural(start: Column, end: Column, duration: Column, index: Column, last: Column) -> dict[str, Column]:
    """Seven structural features; novelty comes from the neighbours. The position is rounded as a product in
    binary, as in SQL: 57 / 800 is stored below 0.07125 and gives 0.0712, where F.round(at, 4) takes the decimal."""
    at = position(start, duration)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "position_ratio": F.round(at * 10000.0) / 10000.0,
        "is_intro": flag(at < 0.10),
        "is_outro": flag(at > 0.90),
        "segment_duration": F.round(end - start, 2),
        "video_duration": F.round(duration, 2),
        "is_first_segment": flag(index == 0),
        "is_last_segment": flag(index == last),
    }


def quarter_flags(start: Column, duration: Column) -> dict[str, Column]:
    """the labeler's variant."""
    at = F.when(duration > 0, start / duration).otherwise(F.lit(0.0))
    return {
        "position_ratio": F.round(at, 4),
        "is_first_quarter": F.when(at < 0.25, 1).otherwise(0),
        "is_last_quarter": F.when(at > 0.75, 1).otherwise(0),
    }


def one_hot(category: Column, categories: list[str] = schema.CATEGORIES) -> dict[str, Column]:
    """unknown and null give zeros."""
    return {f"creator_category_{c}": F.when(category == c, 1.0).otherwise(0.0) for c in categories}


def english_country(country: Column, language: Column) -> Column:
    """Blank passes, then English countries, then English languages; then non-English countries fail."""
    c, lang = F.upper(F.trim(F.coalesce(country, F.lit("")))), F.lower(F.coalesce(language, F.lit("")))
    return (
        F.when(c == "", True)
        .when(c.isin(schema.ENGLISH_COUNTRIES), True)
        .when(lang.startswith("en"), True)
        .when(c.isin(schema.NON_ENGLISH_COUNTRIES), False)
        .otherwise(True)
    )


def duration_class(seconds: Column, allow_zero: bool = False) -> Column:
    """Short, long, or null in between."""
    least = seconds >= 0 if allow_zero else seconds > 0
    return F.when(least & (seconds <= schema.SHORT_SECONDS), "short").when(seconds >= schema.LONG_SECONDS, "long")


def bracket(subscribers: Column) -> Column:
    """Half-open brackets; whatever fits none, even too small, is large."""
    out = F.when(F.lit(False), "")
    for name, (lo, hi) in schema.BRACKETS.items():
        out = out.when((subscribers >= lo) & (subscribers < hi), name)
    return out.otherwise("large")


def clip_unit(value: Column) -> Column:
    """P10: to [0, 1], keeping NaN and null."""
    return F.when(F.isnan(value), value).when(value < 0, 0.0).when(value > 1, 1.0).otherwise(value)


def segment_id(video: Column, index: Column) -> Column:
    """P15; ids of videos that share eight characters collide, which the checks report."""
    return F.format_string("SEG_%s_%03d", F.substring(video, 1, 8), index)


def segment_path(video: Column, index: Column, kind: str, suffix: str) -> Column:
    return F.format_string(f"segments/%s/{kind}/segment_%03d.{suffix}", video, index)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def rule_score(weights: dict[str, float] = schema.RULE_WEIGHTS, columns: list[str] | None = None) -> Column:
    """the sigmoid of the weighted sum, as float. Weights of columns that aren't there count as 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        if columns is None or name in columns:
            total = total + F.lit(w) * F.col(name)
    return sigmoid(total).cast("float")


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length zero or a missing one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def round_even(x: Column, digits: int) -> Column:
    """to so many decimal places as the double's exact binary value demands, halves to even, as Python's
    round() does; 2.675 is below its half and goes to 2.67. Spark's round() looks at the shortest decimal.

    The product with the power of ten and its rounding error are computed exactly (by parts of 26 bits), so
    a value is told apart from a half that it only seems to be. Values with more digits than a double
    keeps, NaN and infinities stay as they are.
    """
    if not 0 <= digits <= 22:
        raise ValueError("0 to 22 places")
    scale, cut = 10.0**digits, 134217729.0
    high = cut * scale - (cut * scale - scale)
    low = scale - high

    def of(v: Column) -> Column:
        p = v * F.lit(scale)
        c = v * F.lit(cut)
        a = c - (c - v)
        b = v - a
        error = ((a * F.lit(high) - p) + a * F.lit(low) + b * F.lit(high)) + b * F.lit(low)
        whole = F.floor(p)
        part = p - whole
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2)) == 1))))
        return F.when(F.isnan(v) | (F.abs(v) > 1e280) | (F.abs(p) >= float(1 << 53)), v).otherwise((whole + up.cast("bigint")) / F.lit(scale))

    return of(x.cast("double"))
