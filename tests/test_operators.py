"""Operators on hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from segmill import schema
from segmill.operators import captions, discovery, engagement, matching, metrics, models, normalise, ranges, segments, splits, stats, validation


def rows(df):
    return [r.asDict() for r in df.collect()]


def make(spark, ddl, data):
    return spark.createDataFrame(data, ddl)


def test_first_candidates(spark):
    df = make(spark, schema.SCHEMAS["candidates"], [("c", "video_search", "tech"), ("c", "seed", "fitness"), ("d", "channel_search", "education"), ("d", "channel_search", "tech")])
    got = {r["channel_id"]: (r["source"], r["search_category"]) for r in rows(discovery.first_candidates(df))}
    assert got == {"c": ("seed", "fitness"), "d": ("channel_search", "tech")}


def test_topics(spark):
    u = lambda *t: [f"https://e/wiki/{x}" for x in t]
    df = make(spark, schema.SCHEMAS["channel_topics"], [("a", u("Knowledge", "Society")), ("b", ["x"]), ("c", []), ("d", u("Sport", "Film", "Nutrition")), ("e", None)])
    got = {r["channel_id"]: r["category"] for r in rows(discovery.topic_category(df))}
    assert got == {"a": "education", "b": None, "c": None, "d": "entertainment", "e": None}


def test_ids_and_machines(spark):
    df = make(spark, "channel_id string, category string, subscribers long, longs_count int", [("x", "fitness", 5, 9), ("y", "tech", 5, 7), ("z", "tech", 9, 7), ("w", "other", 99, 1)])
    got = {r["channel_id"]: r["creator_id"] for r in rows(discovery.creator_ids(df))}
    assert got == {"z": "CR0001", "y": "CR0002", "x": "CR0003", "w": "CR0004"}
    vm = {r["channel_id"]: r["vm_id"] for r in rows(discovery.round_robin(df, 2, ident="channel_id"))}
    assert vm == {"x": "vm0", "y": "vm1", "z": "vm0", "w": "vm1"}
    a, b = (([r["channel_id"] for r in rows(discovery.shuffled(df.repartition(n), 3, "channel_id"))]) for n in (1, 3))
    assert a == b


def test_baselines(spark):
    cols = "video_id string, creator_id string, views long, likes long, comments long, views_per_day double, engagement_rate double, engagement_formula string, excluded_reason string"
    data = [(str(i), "a", v, 1, 1, 2.0, e, "standard", "") for i, (v, e) in enumerate([(1, 0.01), (2, 0.02), (4, 0.04), (9, 0.09)])]
    data += [("n", "b", 7, 1, 1, 1.0, 0.5, "standard", ""), ("r", "b", 7, 1, 1, 1.0, 0.5, "standard", "too_recent"), ("q", "c", 7, 1, 1, 1.0, 0.5, "standard", "too_recent")]
    got = {r["creator_id"]: r for r in rows(engagement.baselines(make(spark, cols, data)))}
    assert set(got) == {"a", "b"}
    assert got["a"]["median_engagement_rate"] == 0.03 and got["a"]["median_views"] == 3 and got["a"]["mean_views"] == 4 and got["a"]["std_views"] == 3
    assert got["b"]["std_views"] == 0 and got["b"]["shorts_excluded_too_recent"] == 1


def test_labels_of_a_segment_with_two_pairs(spark):
    pairs = make(
        spark, "short_id string, long_id string, matched_segment_index int, match_score double, label int, short_views long, short_engagement_rate double, pos int",
        [("s1", "v", 3, 95.0, 0, 1, 0.1, 1), ("s2", "v", 3, 85.0, 1, 2, 0.2, 2), ("s3", "v", 1, 97.0, 1, 3, 0.3, 3), ("s4", "v", 1, 97.0, 0, 4, 0.4, 4)],
    )
    seg = engagement.segments_of(make(spark, "video_id string, creator_id string, category string, duration double", [("v", "CR0001", "tech", 95.0), ("w", "CR0001", "tech", 0.0)]))
    got = {r["segment_index"]: r for r in rows(engagement.label_segments(seg, pairs))}
    assert len(got) == 4 and got[3]["end_time"] == 95.0 and got[3]["duration"] == 5.0
    assert (got[3]["label"], got[3]["match_confidence"], got[3]["matched_short_id"]) == (0, "high", "s1")
    assert (got[1]["label"], got[1]["match_confidence"], got[1]["matched_short_id"]) == (1, "very_high", "s3")
    assert got[0]["matched_short_id"] == "" and got[0]["segment_id"] == "SEG_v_000" and got[0]["is_first_quarter"] == 1
    again = {r["segment_index"]: r["label"] for r in rows(engagement.relabel(engagement.relabel(engagement.label_segments(seg, pairs), pairs), pairs))}
    assert again == {0: 0, 1: 1, 2: 0, 3: 1}
    index = rows(engagement.master_index(engagement.label_segments(seg, pairs)))
    assert {r["short_audio_path"] for r in index} == {"", "raw/shorts/audio/s1.wav", "raw/shorts/audio/s3.wav"} and len(index[0]) == 16


def test_structure(spark):
    seg = engagement.segments_of(make(spark, "video_id string, duration double", [("v", 95.0)]))
    got = {r["segment_index"]: r for r in rows(segments.structural_features(seg))}
    assert [got[i]["position_ratio"] for i in range(4)] == [0.0, 0.3158, 0.6316, 0.9474]
    assert [got[i]["is_intro"] for i in range(4)] == [1, 0, 0, 0] and [got[i]["is_outro"] for i in range(4)] == [0, 0, 0, 1]
    assert [got[i]["is_last_segment"] for i in range(4)] == [0, 0, 0, 1]


def test_novelty(spark):
    e = make(spark, "video_id string, segment_index int, embedding array<float>", [("v", 0, [1.0, 0.0]), ("v", 1, [1.0, 0.0]), ("v", 3, [0.0, 1.0]), ("w", 0, [1.0, 0.0]), ("w", 1, [0.0, 0.0]), ("w", 2, [1.0, 1.0]), ("x", 0, None)])
    got = {(r["video_id"], r["segment_index"]): r["segment_novelty_to_neighbors"] for r in rows(segments.novelty(e))}
    assert got == {("v", 0): 0.0, ("v", 1): 0.0, ("v", 3): 0.0, ("w", 0): 0.0, ("w", 1): 0.0, ("w", 2): 0.0, ("x", 0): 0.0}
    e = make(spark, "video_id string, segment_index int, embedding array<float>", [("v", 0, [1.0, 0.0]), ("v", 1, [0.0, 1.0]), ("v", 2, [0.0, 2.0])])
    got = {r["segment_index"]: r["segment_novelty_to_neighbors"] for r in rows(segments.novelty(e))}
    assert got == {0: 1.0, 1: 0.5, 2: 0.0}
    n = {r["segment_index"]: (r["prev"], r["next"]) for r in rows(segments.neighbours(e.select("video_id", "segment_index", F.col("segment_index").alias("k")), "k"))}
    assert n == {0: (None, 1), 1: (0, 2), 2: (1, None)}


@pytest.mark.parametrize("n,k", [(2, 1), (4, 1), (11, 2)])
def test_arc(spark, n, k):
    a = [float(i * i) for i in range(n)]
    got = make(spark, "a array<double>", [(a,)]).select(segments.arc(F.col("a"))).first()[0]
    assert got == pytest.approx(sum(a[-k:]) / k - sum(a[:k]) / k)


def test_tails(spark):
    df = make(spark, "cut_prob array<double>, duration double", [([0.9, 0.1, 0.6, 0.7, 0.2, 0.8], 4.0), ([], 0.0)])
    assert [(r["cut_count"], r["cuts_per_second"]) for r in rows(segments.cut_features(df))] == [(2.0, 0.5), (0.0, 0.0)]
    f = "faces array<array<struct<score:double,area_ratio:double>>>"
    df = make(spark, f, [([[(0.6, 0.1), (0.4, 0.9)], [], [(0.9, 0.2), (0.8, 0.3), (0.7, 0.05)]],), ([],)])
    got = [tuple(r.values())[1:] for r in rows(segments.face_features(df))]
    assert got[0] == (pytest.approx(2 / 3), 0.3, 1.0) and got[1] == (0.0, 0.0, 0.0)
    df = make(spark, "music array<double>, instrument array<double>, speech array<double>", [([0.0], [0.0], [0.9]), ([0.0], [0.0], [1.0]), ([0.2, 0.1], [0.2, 0.1], [0.3, 0.3])])
    got = [(r["music_presence"], r["music_fraction"], r["speech_music_ratio"]) for r in rows(segments.music_features(df))]
    assert [round(g[2], 6) for g in got] == [90.0, 100.0, 1.0] and got[2][1] == 0.5
    df = make(spark, "rms array<double>, fps double", [([1.0, 1.0, 0.0, 0.0], 0.5), ([0.0, 0.0], 1.0)])
    got = rows(segments.energy_features(df))
    assert got[0]["energy_mean"] == 0.5 and got[0]["energy_first_3s_ratio"] == 2.0 and got[0]["silence_ratio"] == 0.5 and got[1]["energy_first_3s_ratio"] == 1.0
    df = make(spark, "v double, voiced int, n int", [(3.0, 2, 10), (3.0, 1, 10), (float("nan"), 9, 10), (None, 9, 10)])
    assert [r[0] for r in df.select(segments.gated(F.col("v"), F.col("voiced"), F.col("n"), 0.2)).collect()] == [3.0, 0.0, 0.0, 0.0]
    df = make(spark, "k string, embedding array<double>", [("a", [1.0, 3.0]), ("a", [3.0, 5.0])])
    assert rows(segments.mean_pool(df, "k"))[0]["embedding"] == [2.0, 4.0]


def test_complete(spark):
    df = make(spark, "segment_id string, video_id string, creator_id string, category string, segment_index int, label int, word_count double", [("a", "v", "c1", "tech", 0, 0, 3.0), ("b", "v", "c2", "tech", 0, 0, None)])
    got = {r["segment_id"]: r for r in rows(segments.complete(df, "v1"))}
    assert list(got["a"]) == schema.OUTPUT_COLUMNS and got["b"]["word_count"] == 0.0 and got["a"]["energy_first_3s_ratio"] == 1.0
    assert {r["features_version"] for r in got.values()} == {"v1-partial"}
    e = make(spark, "video_id string, segment_index int, embedding array<float>", [("v", 0, [1.0, 2.0])])
    x = rows(segments.attach_embeddings(make(spark, "video_id string, segment_index int", [("v", 0), ("v", 1)]), e, 2))
    assert sorted((r["segment_index"], r["embedding"], r["has_embedding"]) for r in x) == [(0, [1.0, 2.0], True), (1, [0.0, 0.0], False)]


def plain_chunks(entries, seconds=30.0):
    out, start, words = [], None, []
    for s, t in entries:
        if start is not None and s - start >= seconds and words:
            out.append([start, s, words])
            start, words = s, [t]
        else:
            start = s if start is None else start
            words = words + [t]
    if words:
        out.append([start, entries[-1][0] + seconds, words])
    res = []
    for a, b, ws in out:
        flat = " ".join(ws).split()
        res.append((a, b, " ".join(w for i, w in enumerate(flat) if i == 0 or w != flat[i - 1])))
    return res


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\nLanguage: en\n\nNOTE x\n\n00:01.000 --> 00:02.000\n<c>Hello</c> there\n\n00:00:02.500 --> 00:00:03.000\nHello there\n\n1\n00:00:40.000 --> 00:00:41.000 align:start\nnext next\nline\n\nno time\n"
    got = rows(captions.parse_captions(make(spark, "vtt string", [(vtt,), (None,), ("",)])))
    assert got[0]["text"] == "Hello there 1 next next line no time"
    assert [tuple(e) for e in got[0]["entries"]] == [(1.0, "Hello there"), (2.5, "Hello there"), (40.0, "next next line")]
    assert [tuple(c) for c in got[0]["chunks"]] == plain_chunks([tuple(e) for e in got[0]["entries"]])
    assert got[1]["entries"] == [] and got[1]["chunks"] == [] and got[2]["text"] == ""
    entries = [(float(s), f"w{s}") for s in (0, 10, 29, 31, 65)]
    df = make(spark, "e array<struct<start:double,text:string>>", [(entries,)])
    c = df.select(captions.timed_chunks(F.col("e"))).first()[0]
    assert [(x["start"], x["end"]) for x in c] == [(0, 31), (31, 65), (65, 95)]
    rnd = random.Random(2)
    for _ in range(3):
        t, many = 0.0, []
        for _ in range(30):
            t += rnd.random() * 20
            many.append((round(t, 3), " ".join(rnd.choice("abc") for _ in range(4))))
        c = make(spark, "e array<struct<start:double,text:string>>", [(many,)]).select(captions.timed_chunks(F.col("e"))).first()[0]
        assert [tuple(x) for x in c] == plain_chunks(many)


def test_greedy(spark):
    cols = "creator_id string, short_id string, long_id string, short_pos int, long_pos int, score double"
    df = make(spark, cols, [("c", "s1", "A", 1, 1, 90.0), ("c", "s1", "B", 1, 2, 85.0), ("c", "s2", "A", 2, 1, 95.0), ("c", "s2", "B", 2, 2, 84.0), ("c", "s3", "B", 3, 2, 79.0), ("d", "s9", "Z", 1, 1, 80.0)])
    got = {(r["short_id"], r["long_id"]) for r in rows(matching.greedy_assign(df, capacity=1))}
    assert got == {("s1", "A"), ("s2", "B"), ("s9", "Z")}


def test_models_are_registered_with_the_defaults(monkeypatch, spark, sf):
    """No query lowers the numbers of seeds, trees, rounds or trials, and the ablation has all columns there are."""
    from segmill.plans import queries

    seen = {}
    for name in ("random_forest", "boosted_trees", "random_baseline", "ablation", "learning_curve"):
        monkeypatch.setattr(models, name, lambda *a, _n=name, **k: (seen.setdefault(_n, (a, k)), None))
    monkeypatch.setattr(queries.metrics, "evaluate", lambda *a: None)
    for f in (queries.rf_scores, queries.gbt_scores, queries.random_baseline, queries.ablation, queries.learning_curve):
        f(spark, sf)
    assert all(not k for _, k in seen.values()) and len(seen["random_baseline"][0]) == 1
    x, groups, _ = seen["ablation"][0]
    assert sorted(c for g in groups.values() for c in g) == sorted(set(x.columns) - {"segment_id", "video_id", "split", "label"})
    assert len(seen["learning_curve"][0][2]) > 2


def test_pca_project_takes_all_vectors(spark, sf):
    from segmill.plans import queries

    assert queries.pca_project(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_contains_match_with_few_tokens(spark):
    """Shorts of no, one and two tokens, which may begin and end within tokens of the long."""
    texts = ["cat", "on catenary", "concatenation cat", "a b", "xa bx", "", " ", None, "a\nb", "Cat", "antidisestablishment", "an antidisestablishmentarian word here"]
    some = [*texts, "nation ca", "one concatenation cat sat here", "xxa bxx and a b c", "b", "tion cat sat he"]
    t = make(spark, "short_id long, text string", list(enumerate(some)))
    got = sorted((r["short_id"], r["long_id"]) for r in rows(matching.contains_match(t, t.withColumnRenamed("short_id", "long_id"))))
    assert got == sorted((i, j) for i, a in enumerate(some) for j, b in enumerate(some) if a is not None and b is not None and a in b)


def test_segment_match_takes_whole_turns(spark, tmp_path):
    """A turn that shares only the first 300 characters doesn't tie with the whole one."""
    from segmill.plans import queries

    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200)]
    turns = [(1, 0, "user", " ".join(words[:50] + words[100:130])), (1, 1, "assistant", " ".join(words[:100])), (2, 0, "user", " ".join(words[130:180])), (2, 1, "assistant", "no")]
    make(spark, "conv_id long, turn long, role string, text string", turns).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["short_id"]: (r["matched_segment_index"], r["match_score"]) for r in rows(queries.segment_match(spark, str(tmp_path)))}
    assert got == {1: (1, 100.0), 2: (0, 100.0)}


def test_segment_match_of_few_words_and_of_parts(spark, tmp_path):
    """Conversations without a turn of ten words have their row, and a turn within the longest one doesn't go before it."""
    import duckdb

    from segmill.plans import queries

    text = "one two three four five six seven eight nine ten eleven twelve"
    turns = [(1, 0, "only four words here"), (2, 0, "six seven"), (2, 1, text), (2, 2, "other words"), (3, 0, ""), (3, 1, ""), (4, 0, "a b"), (4, 1, "B A"), (5, 0, None), (6, 1, "no no no"), (6, 0, "no"), (7, 0, text[:30]), (7, 1, text)]
    make(spark, "conv_id long, turn long, role string, text string", [(c, k, "user", t) for c, k, t in turns]).write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = sorted(c.execute(queries.ORACLE["segment_match"]).fetchall())
    assert sorted(tuple(r.values()) for r in rows(queries.segment_match(spark, str(tmp_path)))) == want and len(want) == 6


def test_numbers_within_large_groups_by_range(spark, tmp_path):
    """Numbers and sizes as a window gives them, null a group of its own, without a group's rows meeting in one task."""
    from segmill.plans import tables

    data = [(None if k % 5 == 0 else "ab"[k % 2], k * 7919 % 10007, k) for k in range(1500)]
    x = ranges.index_within(make(spark, "g string, o long, k int", data), "g", "o", "i", "n", parts=8)
    got = [(r["g"], r["o"], r["i"], r["n"], r["p"]) for r in rows(x.withColumn("p", F.spark_partition_id()))]
    want = {}
    for g, o, _ in sorted(data, key=lambda t: t[1]):
        want.setdefault(g, []).append(o)
    assert len(got) == 1500 and all(want[g][i] == o and n == len(want[g]) for g, o, i, n, _ in got)
    assert len({p for g, *_, p in got if g == "a"}) > 1
    at = str(tmp_path)
    make(spark, "doc_id long, text string, lang string, source string, n_chars int", [(k, "x", "en", "one", 1) for k in range(500)]).write.parquet(f"{at}/documents.parquet")
    make(spark, "doc_id long, quality int, toxic int", [(k, 1, 0) for k in range(500)]).write.parquet(f"{at}/labels.parquet")
    seg = tables.doc_segments(spark, at)
    assert all(r["segment_index"] == r["segment_id"] and r["video_duration"] == 15000 for r in rows(seg))
    assert seg.select(F.spark_partition_id()).distinct().count() > 1


def test_bounds_of_ranges_are_computed_once(spark, monkeypatch):
    """Approximate quantiles may differ from one computation to the next; here they always do."""
    import random

    moved = F.udf(lambda top: sorted(random.sample(range(top), 7)), "array<long>").asNondeterministic()
    monkeypatch.setattr(ranges.F, "percentile_approx", lambda column, *_: moved(F.max(column)))
    x = ranges.index_within(make(spark, "g string, o long", [("ab"[k % 2], k) for k in range(3000)]), "g", "o", "i", "n", parts=8)
    assert all(r["i"] == r["o"] // 2 and r["n"] == 1500 for r in rows(x))


def test_positions_are_rounded_as_in_sql(spark):
    """At a tie of the decimal the stored number decides: 57 / 800 lies below 0.07125."""
    seg = make(spark, "video_id string, segment_index int, start_time double, end_time double, video_duration double", [("v", k, k * 30.0, k * 30.0 + 30, 24000.0) for k in (25, 57, 69, 113)])
    got = {r["segment_index"]: r["position_ratio"] for r in rows(segments.structural_features(seg))}
    assert got == {25: 0.0313, 57: 0.0712, 69: 0.0862, 113: 0.1412}


def test_dataset_checks_pass_over_nulls_as_in_sql(spark, tmp_path):
    from segmill.plans import queries

    def checks(name, labels):
        make(spark, "doc_id long, text string, lang string, source string, n_chars int", [(k, "x", "en", "one", 1) for k in range(4)]).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        make(spark, "doc_id long, quality int, toxic int", [(k, 1, v) for k, v in enumerate(labels)]).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        return [r["passed"] for r in rows(queries.dataset_checks(spark, f"{tmp_path}/{name}"))]

    assert checks("some", [1, None, 0, None]) == [True, True, True, True, True]
    assert checks("null", [None, None]) == [True, True, None, True, True]
    assert checks("none", []) == [False, True, None, True, None]


def test_rows_are_dealt_out_before_they_cost(spark):
    """Copies of few bytes, and the rows that learners read, come from as many tasks as there are cores."""
    df = make(spark, "video_id string, segment_id long, split string, label int, f double", [(f"v{k % 9}", k, ("train", "val", "test")[k % 3], k % 2, float(k)) for k in range(400)]).coalesce(1)
    spread = lambda x: x.select(F.spark_partition_id()).distinct().count()
    assert spread(models.random_baseline(df, 3)) >= 4
    study = models.boosting.boost(df, {"m": ["f"]}, params=models.boosting.Params(rounds=1, depth=1))
    assert spread(study.data) >= 4
    t = segments.text_features(make(spark, "text string, duration double", [("What now? Why not you. I see", 2.0)]))
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(coalesce(text") == 2  # cut once into words and once into sentences, not for each feature


def test_segment_matches(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)]
    seg = make(spark, "video_id string, segment_index int, text string", [("L", 0, " ".join(words[:20])), ("L", 1, " ".join(words[20:40])), ("L", 3, " ".join(words[40:]))])
    short = make(spark, "short_id string, text string", [("a", " ".join(words[22:38])), ("b", " ".join(words[12:28])), ("c", "too short"), ("d", " ".join(words[32:48]))])
    pairs = make(spark, "short_id string, long_id string", [(s, "L") for s in "abcd"])
    got = {r["short_id"]: (r["matched_segment_index"], r["match_method"], r["match_score"]) for r in rows(matching.best_per_short(matching.segment_scores(pairs, short, seg)))}
    assert got["a"] == (1, "single", 100.0) and got["b"][1] == "combined" and got["b"][0] in (0, 1) and "c" not in got and "d" not in got
    m = make(spark, "short_id string, long_id string, segment_index int, score double, method string, _at int", [("s", "L", 4, 91.0, "combined", 4), ("s", "L", 4, 91.0, "single", -1), ("t", "L", 2, 88.0, "single", -1), ("t", "L", 5, 88.0, "single", -1)])
    best = rows(matching.best_per_segment(m))
    assert [r["method"] for r in best if r["segment_index"] == 4] == ["single"]
    assert {r["short_id"]: r["matched_segment_index"] for r in rows(matching.best_per_short(m))} == {"s": 4, "t": 2}
    w = make(spark, "k string, start int, score double", [("a", 0, 70.0), ("a", 1, 82.0), ("a", 2, 95.0), ("b", 0, 70.0), ("b", 1, 75.0)])
    assert {r["k"]: r["score"] for r in rows(matching.early_exit_score(w, ["k"]))} == {"a": 82.0, "b": 75.0}
    ch = make(spark, "long_id string, start double, end double, text string", [("L", 0.0, 30.0, " ".join(words[:20])), ("L", 30.0, 60.0, " ".join(words[20:40]))])
    assert {r["short_id"]: r["approx_start"] for r in rows(matching.locate(pairs.filter("short_id = 'a'"), short, ch))} == {"a": 30.0}


def test_splits(spark):
    assert splits.split_counts(3709) == {"train": 2596, "val": 556, "test": 557}
    df = make(spark, "video_id string, label int, category string", [(f"v{i % 40}", int(i % 7 == 0), "tech") for i in range(200)])
    x = splits.group_split(df)
    assert not rows(splits.leaks(x)) and sum(r["n_rows"] for r in rows(splits.counts(x))) == 200
    e = splits.exact_group_split(df)
    assert {r["split"]: r["n_groups"] for r in rows(splits.counts(e))} == splits.split_counts(40)
    with pytest.raises(ValueError):
        splits.check_no_leak(df.withColumn("split", F.when(F.col("label") == 0, "train").otherwise("test")))
    with pytest.raises(ValueError):
        splits.load_split(x, "train", ["nothing"])
    small, large = ({r["video_id"] for r in rows(splits.fraction_of_groups(df, f))} for f in (0.3, 0.8))
    assert small < large


def test_zscore(spark):
    df = make(spark, "split string, a double, b double", [("train", 1.0, 4.0), ("train", 2.0, 4.0), ("train", 3.0, 4.0), ("train", float("nan"), 4.0), ("test", 5.0, 9.0)])
    got = [(round(r["a"], 4), r["b"]) for r in rows(normalise.zscore(df, ["a", "b"])) if r["a"] == r["a"]]
    assert sorted(got) == [(-1.2247, 0.0), (0.0, 0.0), (1.2247, 0.0), (3.6742, 0.0)]
    n = rows(normalise.nan_rate(df, ["a", "b"]))[0]
    assert (n["n_missing"], n["n_cells"]) == (1, 10)
    c = rows(normalise.clip_counts(make(spark, "arousal_mean double", [(-1.0,), (2.0,), (float("nan"),), (0.5,)])))
    assert c == [{"feature": "arousal_mean", "under": 1, "over": 1}]


def test_pca_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 6)) * [5, 3, 1, 0.5, 0.2, 0.1] + 7
    df = make(spark, "i int, split string, embedding array<double>", [(i, "train" if i < 40 else "test", x.tolist()) for i, x in enumerate(v)] + [(60, "train", None)])
    model = normalise.fit_pca(df.filter("split = 'train'"), 3)
    got = {r["i"]: r["pca"] for r in rows(normalise.project(df, model))}
    mean = v[:40].mean(0)
    _, _, w = np.linalg.svd(v[:40] - mean, full_matrices=False)
    want = (v - mean) @ w[:3].T
    assert np.allclose(np.abs([got[i] for i in range(60)]), np.abs(want), atol=1e-9) and got[60] == [0.0] * 3


SCORES = "model string, video_id string, segment_id int, y int, score double"


def test_ranking_metrics(spark):
    df = make(spark, SCORES, [("m", "v", i, y, s) for i, (y, s) in enumerate([(0, 0.9), (1, 0.5), (0, 0.5), (1, 0.1)])])
    v = rows(metrics.per_video(df, ["model"]))[0]
    assert v["ndcg_at_3"] == pytest.approx(0.346713, abs=1e-6) and v["precision_at_10"] == 0.5 and v["recall_at_10"] == 1.0
    assert rows(metrics.auc(df, ["model"]))[0]["auc_roc"] == 0.125
    assert rows(metrics.f1(df, ["model"]))[0]["f1"] == pytest.approx(0.4)
    one = df.filter("y = 1")
    assert math.isnan(rows(metrics.auc(one, ["model"]))[0]["auc_roc"])
    more = df.union(make(spark, SCORES, [("m", "w", 9, 0, 0.3), ("m", "u", 10, 1, 0.3)]))
    e = rows(metrics.evaluate(more, ["model"]))[0]
    assert (e["n_videos"], e["n_ranked_videos"]) == (3, 2) and e["ndcg_at_3"] == pytest.approx(0.346713 / 2, abs=1e-6)


def test_metrics_against_brute_force(spark):
    rnd = random.Random(8)
    data = [("m", f"v{i % 7}", i, int(rnd.random() < 0.3), rnd.randrange(6) / 5) for i in range(120)]
    df = make(spark, SCORES, data)
    pos, neg = [d[4] for d in data if d[3]], [d[4] for d in data if not d[3]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert rows(metrics.auc(df, ["model"]))[0]["auc_roc"] == pytest.approx(auc)
    for v in rows(metrics.per_video(df, ["model"])):
        own = [(s, y) for _, w, _, y, s in data if w == v["video_id"]]
        for k in (3, 5, 10):
            order = sorted(own, key=lambda x: -x[0])
            mean = {s: sum(y for t, y in own if t == s) / sum(1 for t, _ in own if t == s) for s, _ in own}
            dcg = sum(mean[s] / math.log2(i + 2) for i, (s, _) in enumerate(order[:k]))
            ideal = sum(y / math.log2(i + 2) for i, y in enumerate(sorted((y for _, y in own), reverse=True)[:k]))
            assert v[f"ndcg_at_{k}"] == pytest.approx(dcg / ideal if ideal else 0.0)


@pytest.mark.parametrize("parts", [2, 3, 64])
def test_running_sums(spark, parts):
    rnd = random.Random(5)
    data = [(g, float(x), float(rnd.randrange(5))) for g in "ab" for x in rnd.sample(range(1000), 60)]
    got = {(r["g"], r["x"]): r["s"] for r in rows(ranges.running_before(make(spark, "g string, x double, v double", data), ["g"], "x", "v", "s", parts))}
    assert got == {(g, x): sum(v for h, y, v in data if h == g and y < x) for g, x, _ in data}


def test_paired_tests(spark):
    r = stats.t_test([1, 2, 3], [2, 4, 6])
    assert r["t"] == pytest.approx(-3.464102, abs=1e-6) and r["p_value"] == pytest.approx(0.074180, abs=1e-6) and r["cohens_d"] == pytest.approx(2.0) and r["direction"] == "b"
    r = stats.t_test([0.5, 0.5], [0.6, 0.6])
    assert r["t"] == -math.inf and r["p_value"] == 0.0 and r["cohens_d"] == 0.0
    assert stats.t_test([1.0], [2.0])["t"] is None
    with pytest.raises(ValueError):
        stats.t_test([1.0, 2.0], [1.0, 2.0, 3.0])
    assert stats.t_p_value(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    df = make(spark, "model string, seed int, metric string, value double", [(m, s, "auc_roc", v) for m, vs in {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0, 6.0], "c": [1.0], "d": [0.5, 0.5], "e": [0.6, 0.6]}.items() for s, v in enumerate(vs)])
    got = {(r["model_a"], r["model_b"]): r for r in rows(stats.compare_models(df))}
    assert set(got) == {("a", "b"), ("d", "e")}
    assert got["a", "b"]["p_value"] == pytest.approx(0.074180, abs=1e-6) and got["a", "b"]["effect"] == "large" and not got["a", "b"]["significant"]
    assert got["d", "e"]["t"] == -math.inf and got["d", "e"]["p_value"] == 0.0 and got["d", "e"]["cohens_d"] == 0.0
    agg = {r["model"]: r for r in rows(metrics.seed_aggregate(df))}
    assert agg["c"]["std"] == 0.0 and agg["a"]["std"] == 1.0 and agg["a"]["values"] == [1.0, 2.0, 3.0]


def test_spearman_and_density(spark):
    import pandas as pd

    rnd = random.Random(4)
    p = pd.DataFrame({"label": [rnd.randrange(2) for _ in range(80)], "a": [rnd.randrange(9) * 1.0 for _ in range(80)], "b": [1.0] * 80})
    got = {r["feature"]: r["rho"] for r in rows(stats.spearman(spark.createDataFrame(p), ["a", "b"]))}
    want = abs(p["a"].rank().corr(p["label"].rank()))
    assert got["a"] == pytest.approx(want, abs=1e-6) and got["b"] == 0.0
    d = rows(stats.density(make(spark, "y int, x double", [(0, 1.0), (0, 0.0), (1, 0.99)]), "x", "y"))
    assert {(r["y"], r["bin"], r["density"]) for r in d} == {(0, 19, 10.0), (0, 0, 10.0), (1, 19, 20.0)}


def test_validation(spark):
    seg = make(spark, "segment_id string, label int, position_ratio double, category string, creator_id string, video_id string", [("a", 0, 0.5, "x", "c", "v"), ("a", 2, 1.5, "x", "c", "v")])
    assert {r["check_name"]: r["passed"] for r in rows(validation.segment_checks(seg))} == {
        "segments_exist": True, "labels_0_or_1": False, "positives_exist": True, "unique_segment_ids": False, "position_ratio_in_unit": False
    }
    with pytest.raises(ValueError):
        validation.check_unique(seg)
    with pytest.raises(ValueError):
        validation.check_columns(seg)
    assert rows(validation.labels_subset(seg)) == [{"labels_ok": False}]
    m = make(spark, schema.SCHEMAS["progress"], [("a", "done", 10, 2, 3, 4, 1), ("b", "cpu_done", 5, 9, 1, 9, 9), ("c", "skipped", 0, 0, 0, 0, 0), ("d", "error", 0, 0, 0, 0, 0)])
    c = make(spark, "creator_id string", [(x,) for x in "abcde"])
    r = rows(validation.progress_summary(m, c))[0]
    assert (r["done"], r["cpu_done"], r["skipped"], r["errors"], r["pending"], r["total"]) == (2, 1, 1, 1, 1, 5)
    assert r["total_segments"] == 15 and r["total_positive_segments"] == 2 and r["total_caption_pairs"] == 4
    claims = make(spark, "creator_id string, heartbeat double", [("b", 0.0), ("c", 900.0)])
    p = rows(validation.pool_status(c, make(spark, "creator_id string", [("a",)]), claims, 7500.0))[0]
    assert (p["total"], p["done"], p["active"], p["stale"], p["pending"], p["oldest_claim_s"]) == (5, 1, 1, 1, 2, 7500.0)


def test_random_baseline_is_chance(spark):
    df = make(spark, "segment_id string, video_id string, split string, label int", [(f"s{i}", f"v{i % 20}", "test", int(i % 5 == 0)) for i in range(1000)])
    auc = [r["auc_roc"] for r in rows(metrics.auc(models.random_baseline(df, 20), ["model", "seed"]))]
    assert len(auc) == 20 and abs(sum(auc) / 20 - 0.5) < 0.03
    assert models.class_weight(df) == 4.0
    with pytest.raises(ValueError):
        models.rule_based(df)


def test_colour_of_a_grey_and_a_red_frame(spark):
    rows = [(1, 0, 100, 100, 100), (1, 0, 200, 200, 200), (1, 1, 255, 0, 0), (1, 1, 255, 0, 0)]
    got = segments.colour_features(spark.createDataFrame(rows, "segment_id int, frame int, r int, g int, b int")).first()
    red = 0.3 * (255**2 + 127.5**2) ** 0.5  # no deviation, both opponent means
    assert got["colorfulness"] == pytest.approx(red / 2)
    assert got["brightness_mean"] == pytest.approx((150 / 255 + 1) / 2)


def test_union_difference_order_and_numbers(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string"), spark.createDataFrame([(1,), (None,)], "k int")
    assert sorted(map(str, validation.bag_union([a, b]).collect())) == sorted(map(str, spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (None, None)], "k int, v string").collect()))
    assert validation.rows_missing(a.select("k"), b).count() == 1
    scores = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), ("d", 1.0)], "m string, v double").repartition(3)
    assert [r["m"] for r in metrics.report_order(scores, "v", "m").collect()] == ["c", "a", "d", "b"]
    assert [r["m"] for r in metrics.report_order(scores, "v", "m", best_first=False).collect()] == ["a", "d", "c", "b"]
    x = spark.range(100, numPartitions=7).select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    assert [(r["id"], r["position"]) for r in discovery.numbered(x).orderBy("id").collect()] == [(i, i + 1) for i in range(100)]


@pytest.mark.parametrize("pairs", [4096, 3])
def test_caption_scores_against_brute_force(spark, monkeypatch, pairs):
    """Windows in turn, the first that reaches the bound settles the score; hot creators are dealt out."""
    from segmill.functions import similarity

    monkeypatch.setattr(matching, "PAIRS", pairs)
    rnd = random.Random(3)
    words = lambda n: " ".join("".join(rnd.choice("abcdeFGH") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    shorts, longs = [], []
    for k in range(24):
        c = "hot" if k % 3 else f"c{k % 2}"
        body = words(30)
        cut = body.split(" ")
        del cut[rnd.randrange(len(cut)) : rnd.randrange(len(cut))]
        shorts.append((c, k, k, " ".join(cut) if k % 4 else words(rnd.choice([1, 25]))))
        longs.append((c, k, k, words(rnd.choice([0, 10, 300])) + " " + body + " " + words(rnd.choice([0, 200, 500])) if k % 5 else None))
    s, t = make(spark, "creator_id string, short_id int, pos int, text string", shorts), make(spark, "creator_id string, long_id int, pos int, text string", longs)
    got = {(r["short_id"], r["long_id"]): r["score"] for r in rows(matching.caption_scores(s, t))}
    want = {}
    for c, i, _, a in shorts:
        for d, j, _, b in longs:
            if c == d and a and b and len(a) >= 20 and len(b) > 100:
                x = similarity.windowed_score(a, b)
                if x >= 80:
                    want[i, j] = x
    assert got == pytest.approx(want) and len(want) > 5


def test_hot_videos_are_not_gathered(spark):
    """A video with a third of all rows, most of them tied: the result of brute force, and ranks that are
    limited before the shuffle by video."""
    rnd = random.Random(21)
    data = [("m", "hot" if i % 3 == 0 else f"v{i % 11}", i, int(rnd.random() < 0.2), rnd.choice([0.5, 0.5, 0.25, rnd.randrange(40) / 40])) for i in range(900)]
    df = make(spark, SCORES, data).repartition(5)
    x = metrics.per_video(df, ["model"])
    assert x._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
    for v in rows(x):
        own = sorted(((-s, i, y) for _, w, i, y, s in data if w == v["video_id"]))
        assert (v["n_segments"], v["n_positives"]) == (len(own), sum(y for _, _, y in own))
        for k in (3, 5, 10):
            hits = sum(y for _, _, y in own[:k])
            assert v[f"precision_at_{k}"] == pytest.approx(hits / min(k, len(own))) and v[f"recall_at_{k}"] == pytest.approx(hits / max(1, v["n_positives"]))
            mean = {s: sum(y for t, _, y in own if t == s) / sum(1 for t, _, _ in own if t == s) for s, _, _ in own[:k]}
            dcg = sum(mean[s] / math.log2(r + 2) for r, (s, _, _) in enumerate(own[:k]))
            ideal = sum(1 / math.log2(r + 2) for r in range(min(k, v["n_positives"])))
            assert v[f"ndcg_at_{k}"] == pytest.approx(dcg / ideal if ideal else 0.0)


def test_nth_smallest(spark):
    rnd = random.Random(2)
    some = sorted({rnd.randrange(1 << 60) for _ in range(300)} | {5, 6, 7, (1 << 60) - 1, 1 << 48, (1 << 48) + 1})
    df = make(spark, "h long", [(h,) for h in some])
    ns = [0, 1, 2, 3, 150, len(some) - 1, len(some)]
    assert [sum(h < b for h in some) for b in splits.nth_smallest(df, "h", ns)] == ns


@pytest.mark.parametrize("n", [1, 2, 3, 7, 101])
def test_exact_split_has_the_counts(spark, n):
    df = make(spark, "video_id long, label int", [(k % n, k % 2) for k in range(3 * n)] + [(None, 1)])
    x = splits.exact_group_split(df, seed=7)
    got = {r["split"]: r["n"] for r in rows(x.groupBy("split").agg(F.countDistinct("video_id").alias("n")))}
    assert {k: v for k, v in got.items() if k} == {k: v for k, v in splits.split_counts(n).items() if v}
    assert not rows(splits.leaks(x.filter("video_id IS NOT NULL"))) and x.filter("split IS NULL").count() == 1


def test_relabel_at_thresholds(spark):
    cols = "short_engagement_rate double, creator_median_engagement_rate double, short_views_per_day double, creator_median_views_per_day double, label int"
    p = make(spark, cols, [(0.3, 0.1, 1.0, 10.0, 0), (0.15, 0.1, 25.0, 10.0, 0), (0.3, 0.0, None, None, 1)])
    assert [r["label"] for r in rows(engagement.relabel_pairs(p))] == [1, 0, 0] and [r["label"] for r in rows(engagement.relabel_pairs(p, 4.0, 2.0))] == [0, 1, 0]


@pytest.mark.parametrize("seed,capacity", [(1, 1), (2, 2), (3, 5)])
def test_assignment_equals_the_walk(spark, seed, capacity):
    """One creator has most rows; scores tie, and shorts compete for the same longs."""
    rnd = random.Random(seed)
    data = []
    for s in range(90):
        c = "hot" if s % 4 else rnd.choice(["a", None])
        for t in rnd.sample(range(14), rnd.randint(0, 8)):
            data.append((c, s, f"L{t}", (s * 7) % 90, t // 2, float(rnd.choice([79, 80, 80, 85, 85, 90, 95]))))
    used, want = {}, set()
    for c, s in sorted({(d[0], d[1]) for d in data}, key=lambda x: ((x[1] * 7) % 90, x[1])):
        best = None
        for d in sorted((d for d in data if d[0] == c and d[1] == s), key=lambda d: (d[4], d[2])):
            if used.get((c, d[2]), 0) < capacity and (best is None or d[5] > best[5]) and d[5] >= 80:
                best = d
        if best:
            used[c, best[2]] = used.get((c, best[2]), 0) + 1
            want.add((c, s, best[2], best[5]))
    df = make(spark, "creator_id string, short_id int, long_id string, short_pos int, long_pos int, score double", data)
    assert {(r["creator_id"], r["short_id"], r["long_id"], r["caption_score"]) for r in rows(matching.greedy_assign(df, capacity=capacity))} == want


def test_edited_segment_match_against_brute_force(spark, tmp_path):
    """Scores below 100, combined matches and misses, each as by trying every window."""
    import re

    from segmill.plans import queries
    from tests.test_functions import naive_partial

    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgi") for _ in range(rnd.randint(2, 4)))
    turns = {(c, k): " ".join("the" if (r := rnd.random()) < 0.08 else word() + "ing" * (r > 0.9) for _ in range(rnd.randint(14, 19))) for c in range(10) for k in range(4) if (c, k) != (3, 2)}
    make(spark, "conv_id long, turn long, role string, text string", [(c, k, "user", t) for (c, k), t in turns.items()]).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c in range(10):
        own = {k: t for (d, k), t in turns.items() if d == c}
        k = max(own, key=lambda k: (len(own[k]), -k))
        a, b = own[k], own.get(k + 1)
        parts = [a[len(a) // 3 :]] + ([b[: len(b) // 4]] if b else [])
        short = re.sub(" (the|of) ", " ", re.sub(r"ing\b", "ed", " ".join(parts)))
        if len(short.split()) < 10:
            continue
        found = {}
        for i, t in own.items():
            s = naive_partial(short, t)
            if s >= 80:
                found.setdefault(i, []).append((s, 1, 1, "single"))
            if i + 1 in own and (both := naive_partial(short, f"{t} {own[i + 1]}")) >= 80:
                found.setdefault(i if s >= naive_partial(short, own[i + 1]) else i + 1, []).append((both, 0, -i, "combined"))
        best = {i: max(v) for i, v in found.items()}
        if best:
            i = max(best, key=lambda i: (best[i][0], -i))
            want[c] = (i, pytest.approx(best[i][0], abs=0.051), best[i][3], "very_high" if best[i][0] >= 90 else "high")
    got = {r["short_id"]: (r["matched_segment_index"], r["match_score"], r["match_method"], r["match_confidence"]) for r in rows(queries.edited_segment_match(spark, str(tmp_path)))}
    assert got == want and len(want) > 5 and any(r[1] < 100 for r in got.values())
