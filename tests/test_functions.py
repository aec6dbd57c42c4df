"""Column functions on hand-made cases."""

import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segmill import schema
from segmill.functions import lcs, scalar, similarity, text


def one(spark, ddl, row, *cols):
    r = spark.createDataFrame([row], ddl).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


SAMPLE = "Why do you think this is the secret? I never knew. Stop - now!"


def test_text_features(spark):
    f = text.text_features(F.col("t"), F.col("d"))
    got = spark.createDataFrame([(SAMPLE, 10.0)], "t string, d double").select(*[c.alias(k) for k, c in f.items()]).first().asDict()
    want = {
        "word_count": 14, "words_per_second": 1.4, "hook_word_count": 5, "hook_word_ratio": 0.357143, "question_count": 2, "question_density": 0.6667,
        "second_person_ratio": 0.071429, "first_person_ratio": 0.071429,
    }
    assert got == want


@pytest.mark.parametrize("t,n", [("Hello ... world", 3), ("", 0), (None, 0), ("  ", 0)])
def test_word_count(spark, t, n):
    assert one(spark, "t string", (t,), F.size(text.clean_words(F.col("t")))) == n


def test_legacy_blank_text(spark):
    f = text.text_features(F.col("t"), F.lit(1.0), legacy_nan=True)["word_count"]
    assert one(spark, "t string", ("",), f) == 1


def test_word_times(spark):
    words = [("a", 0.0, 0.5), ("secret", 0.6, 1.0), ("now", 2.0, 2.5), ("hack", 4.9, 5.1)]
    f = text.timed_features(F.col("w"))
    assert one(spark, "w array<struct<word:string,start:double,end:double>>", (words,), *f.values()) == (0.666667, 2.3529)
    assert one(spark, "w array<struct<word:string,start:double,end:double>>", (words[:1],), *f.values()) == (0.0, 0.0)
    assert one(spark, "w array<struct<word:string,start:double,end:double>>", ([],), *f.values()) == (0.0, 0.0)


def test_lists(spark):
    assert one(spark, "x array<string>", (["a", "a", "b", "a", "a"],), text.without_repeats(F.col("x"))) == ["a", "b", "a"]
    assert one(spark, "x array<string>", ([],), text.without_repeats(F.col("x"))) == []
    assert one(spark, "x string", ("a, b,,nan,c",), text.id_list(F.col("x"))) == ["a", "b", "c"]
    assert one(spark, "x string", ("https://e/w/Sport",), text.url_topic(F.col("x"))) == "Sport"
    assert one(spark, "x string", ("x",), text.url_topic(F.col("x"))) == ""
    assert one(spark, "x string", ("UCabc",), text.uploads_playlist(F.col("x"))) == "UUabc"


@pytest.mark.parametrize("t,s", [("PT1H2M3S", 3723), ("PT45S", 45), ("PT", 0), ("P1DT2H", 0), (None, 0)])
def test_iso_seconds(spark, t, s):
    assert one(spark, "t string", (t,), scalar.iso_seconds(F.col("t"))) == s


@pytest.mark.parametrize("t,s", [("00:01:23.456", 83.456), ("01:23,5", 83.5), ("7", 0.0), ("a:b", 0.0)])
def test_timestamp(spark, t, s):
    assert one(spark, "t string", (t,), scalar.timestamp_seconds(F.col("t"))) == pytest.approx(s)


def test_ages(spark):
    rows = [("2024-01-08 00:00:00", 7, False), ("2024-01-14 23:00:00", 1, True), ("2024-01-08 00:00:01", 6, True)]
    now = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    for t, days, young in rows:
        assert one(spark, "t string", (t,), scalar.days_live(F.to_timestamp("t"), now), scalar.too_recent(F.to_timestamp("t"), now)) == (days, young)
    assert one(spark, "h double", (0.0,), scalar.stale(F.col("h"), F.lit(7200.0)), scalar.stale(F.col("h"), F.lit(7201.0))) == (False, True)


@pytest.mark.parametrize("c,lang,ok", [("", "hi", True), ("IN", "en-IN", True), ("IN", "hi", False), ("SE", "", True), (None, None, True), ("us", "fr", True)])
def test_country(spark, c, lang, ok):
    assert one(spark, "c string, l string", (c, lang), scalar.english_country(F.col("c"), F.col("l"))) is ok


def test_brackets_and_classes(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (9_999, 10_000, 100_000, 500_000)], "s long").select(scalar.bracket(F.col("s"))).collect()]
    assert got == ["large", "small", "medium", "large"]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in (0, 60, 61, 419, 420)], "s int").select(scalar.duration_class(F.col("s")), scalar.duration_class(F.col("s"), True)).collect()]
    assert got == [(None, "short"), ("short", "short"), (None, None), (None, None), ("long", "long")]


def test_clip_keeps_missing(spark):
    got = [r[0] for r in spark.createDataFrame([(-0.1,), (1.2,), (float("nan"),), (None,), (0.5,)], "x double").select(scalar.clip_unit(F.col("x"))).collect()]
    assert got[:2] == [0.0, 1.0] and got[2] != got[2] and got[3] is None and got[4] == 0.5


def test_virality(spark):
    er = scalar.exceeds(F.col("e"), F.col("m"), 2.0)
    rows = [(0.06, 0.03, False), (0.061, 0.03, True), (1.0, 0.0, False), (1.0, None, False)]
    for e, m, want in rows:
        assert one(spark, "e double, m double", (e, m), er) is want
    assert one(spark, "s double", (90.0,), scalar.confidence(F.col("s"))) == "very_high"


def test_engagement(spark):
    f = scalar.engagement_rate(F.col("l"), F.col("c"), F.col("v"), F.col("off"))
    assert one(spark, "l long, c long, v long, off boolean", (3, 1, 100, False), f) == 0.04
    assert one(spark, "l long, c long, v long, off boolean", (3, 1, 100, True), f) == 0.03
    assert one(spark, "l long, c long, v long, off boolean", (3, 1, 0, False), f) == 0.0


def test_schema():
    schema.check_groups()
    assert len(schema.FEATURE_COLUMNS) == 84 and len(schema.OUTPUT_COLUMNS) == 92
    assert len(set(schema.HOOK_WORDS)) == 129
    with pytest.raises(ValueError):
        schema.check_groups({**schema.GROUPS, "again": ["word_count"]})


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def naive_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    wins = [b[max(e - n, 0) : min(e, len(b))] for e in range(1, len(b) + n)]
    return max(200.0 * naive_lcs(a, w) / (n + len(w)) for w in wins if w)


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=14), st.text("abc ", max_size=30))
def test_partial_ratio_is_the_naive_one(a, b):
    want = naive_partial(a, b)
    assert similarity.partial_ratio(a, b) == pytest.approx(want)
    got = similarity.partial_ratio(a, b, 80.0)
    assert got == pytest.approx(want) if want >= 80 else got < 80


def test_windows_settle_early(monkeypatch):
    scores = iter([70.0, 82.0, 95.0])
    monkeypatch.setattr(similarity, "partial_ratio", lambda a, b, least=0.0: next(scores))
    assert similarity.windowed_score("x" * 30, "y" * 4000) == 82.0
    scores2 = iter([70.0, 75.0, 60.0])
    monkeypatch.setattr(similarity, "partial_ratio", lambda a, b, least=0.0: next(scores2))
    assert similarity.windowed_score("x" * 30, "y" * 4000) == 75.0


def test_pruning_loses_nothing(spark):
    from segmill.operators.matching import may_match

    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        s = "".join(rnd.choice("abcde ") for _ in range(rnd.randrange(1, 40)))
        t = list("".join(rnd.choice("abcde ") for _ in range(20)) + s + "".join(rnd.choice("abcde ") for _ in range(20)))
        for _ in range(rnd.randrange(0, 12)):
            t[rnd.randrange(len(t))] = rnd.choice("abcde ")
        rows.append((s, "".join(t)))
    got = spark.createDataFrame(rows, "s string, t string").withColumn("ok", may_match(F.col("s"), F.col("t"))).collect()
    assert all(r["ok"] for r in got if similarity.windowed_score(r["s"], r["t"]) >= 80)


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def naive_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n:
        return 0.0 if m else 100.0
    windows = [b[max(x, 0) : min(x + n, m)] for x in range(1 - n, m)]
    return max(200.0 * naive_lcs(a, w) / (n + len(w)) for w in windows)


def some_pairs(seed, n):
    """Pairs with planted edited copies, also of several words of bits, and beyond the basic plane."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        letters = rnd.choice(["ab", "abc", "abcdefgh", "aé\u20ac\U0001f600"])
        a = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 5, 20, 63, 64, 65, 90])))
        b = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 30, 80, 130])))
        if rnd.random() < 0.5 and a and b:
            k = rnd.randrange(len(b))
            b = b[:k] + "".join(c for c in a if rnd.random() > 0.15) + b[k:]
        out.append((a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("way", ["array", "integer"])
def test_partial_ratios_of_many_pairs(monkeypatch, seed, way):
    """Both ways to step are exact, and no score of at least the bound is lost."""
    from segmill.functions import lcs

    monkeypatch.setattr(lcs, "_CALL", -1e9 if way == "array" else 1e9)
    pairs = some_pairs(seed, 60)
    want = [naive_partial(a, b) for a, b in pairs]
    for least in (0.0, 60.0, 80.0):
        got = similarity.partial_ratios([a for a, _ in pairs], [b for _, b in pairs], least)
        for g, w in zip(got, want):
            assert g == pytest.approx(w) if w >= least else g == 0.0 or g == pytest.approx(w)


def test_word_classes():
    from segmill.functions.lcs import word_class

    assert [word_class(64 * k) for k in (0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 17, 24, 25)] == [1, 1, 2, 3, 4, 6, 6, 8, 12, 12, 16, 24, 24, 32]


def test_round_even_is_that_of_python(spark):
    """A million doubles of all sizes, with true halves and what only looks like one, and the known examples."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    values = np.concatenate([
        rng.normal(0, 1, 300_000) * 10.0 ** rng.integers(-6, 12, 300_000),
        rng.integers(-(10**7), 10**7, 350_000) / 10.0 ** rng.integers(0, 7, 350_000),  # short decimals: halves and near halves
        rng.integers(-(10**7), 10**7, 350_000) / 2.0 ** rng.integers(0, 9, 350_000),  # true halves
        [2.675, 2.5, 0.5, 1.5, -2.5, 1.005, 0.00125, 1e15 + 0.3, 1e22, -0.0, 5e-324, 0.125, 1e300],
    ])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = df.select("x", *[scalar.round_even(F.col("x"), d).alias(f"r{d}") for d in (0, 1, 2, 4, 6)]).toPandas()
    for d in (0, 1, 2, 4, 6):
        want = np.array([round(v, d) for v in got["x"].tolist()], np.float64)
        assert (got[f"r{d}"].to_numpy() == want).all(), d
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(scalar.round_even(F.col("x"), 2).alias("r")).collect()
    assert str([r["r"] for r in odd]) == "[nan, inf, None]"


def test_masks_backwards_need_little_memory():
    rnd = random.Random(5)
    texts = [np.array([rnd.randrange(97, 123) for _ in range(rnd.randrange(1800, 1921))], np.uint32) for _ in range(60)]
    tracemalloc.start()
    masks = lcs.Masks(texts, 30)
    back = masks.backwards()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (back.table == lcs.Masks([t[::-1] for t in texts], 30).table).all()
    assert peak < 8 * masks.table.nbytes
