"""WARC, language ID, quality, url rules and the pipeline."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from segmill.llm import language_id, quality, queries, url_filter, warc
from segmill.llm.id_ranges import id_ranges
from segmill.session import shared_dir
from tests.llm.conftest import ROWS, docs, empty


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, kind int, digest string")


LONG = "<p>" + "äb" * 60
PAGES = [
    (4, "http://a/1", LONG), (2, "http://a/2\r\nX: y", LONG), (9, None, LONG), (2, "http://a/2", LONG), (1, "http://b/", "short"), (3, "http://b/", "short"),
    (5, "http://c/", None), (6, "http://c/", ""), (None, "http://n/", LONG), (7, "http://d/", "\x00\r\n\r\nWARC/1.1\r\n" * 30), (8, "http://d/", "z" * 300_000),
]


def want_pages():
    out = []
    low = min(i for i, _, h in PAGES if h == LONG and i is not None)
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = h == LONG and i is not None and i > low
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 20, 400])
def test_op1_round_trip(spark, size):
    df, out = pages(spark, PAGES).repartition(3), shared_dir(spark)
    manifest = warc.write_warc(df, out, file_bytes=size)
    got = rows_of(warc.read_warc(manifest, out, with_payload=True))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want_pages()
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    files = rows_of(manifest)
    assert sum(f["records"] for f in files) == len(PAGES)
    import pyarrow.fs as pafs

    fs, top = pafs.FileSystem.from_uri(out)
    listed = {f["file"] for f in files}
    assert {x.base_name for x in fs.get_file_info(pafs.FileSelector(f"{top}/data"))} == listed
    assert not fs.get_file_info(pafs.FileSelector(f"{top}/tmp"))
    for f in files:
        assert hashlib.sha256(fs.open_input_stream(f"{top}/data/{f['file']}", compression=None).read()).hexdigest() == f["sha256"]
    # Written again, the records are the same bytes.
    again = shared_dir(spark)
    second = warc.write_warc(df, again, file_bytes=size)
    assert sorted(f["sha256"] for f in rows_of(second)) == sorted(f["sha256"] for f in files)


def test_op1_files_do_not_depend_on_partitions(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", (20_000, 40_000))
    df = spark.read.parquet(f"{sf}/pages.parquet")
    df = df.union(df.limit(30).select(F.lit(None).cast("long").alias("page_id"), "url", "html")).union(df.limit(30).select(F.lit(7).cast("long").alias("page_id"), "url", "html"))
    found = []
    for k, parts in enumerate((3, 16)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        warc.write_warc(df.repartition(parts), f"file://{tmp_path}/{k}", file_bytes=9_000)
        found.append({f.name: f.read_bytes() for f in (tmp_path / str(k) / "data").iterdir()})
        assert not list((tmp_path / str(k) / "tmp").iterdir())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found[0]) > 10 and found[0] == found[1]


def test_op1_reader_checks_the_manifest(spark, tmp_path):
    manifest = warc.write_warc(pages(spark, PAGES), f"file://{tmp_path}/w")
    wrong = manifest.withColumn("sha256", F.lit("0" * 64))
    with pytest.raises(Exception, match="manifest says"):
        warc.read_warc(wrong, f"file://{tmp_path}/w").collect()


def test_id_ranges_hold_all_ids_in_order(spark):
    rnd = random.Random(6)
    near = [rnd.randrange(1000) for _ in range(300)] + [(1 << 62) + rnd.randrange(5000) for _ in range(300)] + [-(1 << 63), (1 << 63) - 1]
    for ids in (near, near + [5] * 400, near + [None] * 400, [None] * 9, [3], []):
        df = spark.createDataFrame([(i, 1, k) for k, i in enumerate(ids)], "id long, weight long, k long")
        r = id_ranges(df.select("id", "weight"), target=40)
        got = [(x["part"], x["id"]) for x in r.with_part(df, "id", F.col("k")).collect()]
        assert sorted((i is not None, i or 0) for _, i in got) == sorted((i is not None, i or 0) for i in ids)
        count = Counter(p for p, _ in got)
        assert all(0 <= p < r.parts for p in count) and max(count.values(), default=0) <= 80
        by = {}
        for p, i in got:
            by.setdefault(p, set()).add(-(1 << 64) if i is None else i)
        order = [by[p] for p in sorted(by)]
        assert all(max(a) <= min(b) for a, b in zip(order, order[1:]))


def test_op1_empty_and_damage(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    good = warc.record(1, "http://a", b"x" * 200, None)
    assert warc.parse(good)["payload"] == b"x" * 200
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"xx", b"xy", 1))


def test_op3(spark):
    rnd = random.Random(2)
    syl = {"aa": ["ka", "ti", "mo", "ra"], "bb": ["sch", "ung", "eit", "er"], "cc": ["éa", "oux", "lle", "çon"]}
    rows = []
    for i in range(600):
        lang = list(syl)[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(syl[lang]) for _ in range(3)) for _ in range(rnd.randrange(5, 40))), lang if i % 10 else None))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (1003, "katimo " * 30_000, None), (1004, "éaoux", None), (1004, "éaoux", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, lang_pred int")
    got = {r["doc_id"]: r for r in rows_of(language_id.detect(df))}
    import zlib

    for i, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    right = [got[i]["lang_pred"] == list(syl)[i % 3] for i in range(600) if got[i]["held_out"]]
    assert np.mean(right) > 0.98
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003]["lang_pred"] == "aa" and got[1004]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.detect(df.limit(0)).count() == 0
    none = rows_of(language_id.detect(df.withColumn("lang", df.lang.substr(0, 0).cast("string")).filter("doc_id = 5").selectExpr("doc_id", "text", "cast(null as string) lang")))
    assert none[0]["lang_pred"] == "und"


def test_kernel_scores_are_the_kernel_expansion():
    """Against sets of n-grams and sums over landmarks, one by one; letters beyond the frequent ones go by block."""
    texts = ["katimora tika", "schungeit er ж", "moka rati 語", "eiter ung жз", "tira ka 語語", "scher ung"]
    m = language_id.Model(texts, ["a", "b"] * 3, landmarks=6)
    frequent = {c: k + 1 for k, c in enumerate(m.spectrum.letters)}
    symbol = lambda c: 0 if not c.isalpha() else frequent.get(c, language_id.SYMBOLS - language_id.BLOCKS + (ord(c) >> 7) % language_id.BLOCKS)
    grams = lambda t: {tuple(x) for n in (1, 2, 3) for x in zip(*[[symbol(c) for c in t.lower()][i:] for i in range(n)])}
    df = Counter(g for t in texts for g in grams(t))
    known = {g for g, n in df.items() if n > 1}
    assert m.spectrum.size == len(known)

    def kernel(a, b):
        a, b = grams(a) & known, grams(b) & known
        return len(a & b) / max(1, len(a) * len(b)) ** 0.5

    marks = texts[::2] + texts[1::2]
    for t in [*texts, "kati ung", "new жж 語", "zz"]:
        margin = np.array([sum(kernel(t, s) * m.coef[j, k] for j, s in enumerate(marks)) + m.bias[k] for k in range(2)])
        e = np.exp(m.steep * (margin - margin.max()))
        (lang,), (score,) = m.predict([t])
        assert lang == "ab"[int(margin.argmax())] and abs(score - e.max() / e.sum()) < 1e-4


def test_quality_scores_word_by_word():
    """Against the mean of vectors and the two layers, one by one."""
    rnd = random.Random(8)
    good = [" ".join(rnd.choice(["the", "of", "house", "river"]) for _ in range(9)) for _ in range(30)]
    bad = ["\n".join(["buy buy NOW!"] * rnd.randrange(1, 5)) for _ in range(30)]
    m = quality.Model(good + bad, [1] * 30 + [0] * 30)
    at, vectors, net = m.words.at, m.words.vectors, m.net
    for t in [*good[:3], *bad[:3], "", None, "unseen Words 7!", "the the the\nthe the the", "x" * 3000]:
        words = (t or "").split()
        total = sum((vectors[at.get(w, at.get(quality.shape(w), len(vectors) - 1))] for w in words), np.zeros(quality.SIZE))
        seen, lines, last = set(), set(), None
        for w in words:
            total = total + vectors[0] * (w == last) + vectors[1] * (w in seen)
            seen.add(w)
            last = w
        for line in (t or "").split("\n"):
            total = total + vectors[2] * (line in lines) * bool(words)
            lines.add(line)
        x = (total / (len(words) + quality.PRIOR) - net.mean) / net.std
        hidden = [np.tanh(sum(x[i] * net.p[0][i, h] for i in range(len(x))) + net.p[1][h]) for h in range(quality.HIDDEN)]
        z = (sum(v * w for v, w in zip(hidden, net.p[2])) + net.p[3][0]) / m.temperature
        assert abs(m.score([t])[0] - 1 / (1 + np.exp(-z))) < 1e-3


def test_op7(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["the", "of", "house", "river", "walks", "slowly", "and"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY", "x$$", "now!!", "%%%"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(500)] + [(1000, None), (1001, ""), (1002, "the " * 50_000), (1003, "the house"), (1003, "the house")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(500)] + [(7, None, 1), (None, 1, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows_of(quality.classify(df, labels))}
    assert len(got) == 504
    right = [(got[i]["score"] >= 0.5) == (i % 4 > 0) for i in range(500) if got[i]["held_out"]]
    assert np.mean(right) > 0.98
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    assert got[1000]["score"] == got[1001]["score"]
    assert quality.classify(df.limit(0), labels).count() == 0
    assert {r["score"] for r in rows_of(quality.classify(df, labels.limit(0)))} == {0.5}


def brute_rule(url, rules):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    e = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    path = path[:e]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)))
    return host, path, best.host + best.path, best.verdict


def test_op8_against_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    hosts = ["com", "example.com", "a.example.com", "xcom", "EXAMPLE.net", "b.c.example.net", "org", "x.org:80", "", "ÄB.com", "a..com"]
    paths = ["", "/", "/en/", "/en/7", "/en", "/de/8/x", "/de/", "/es/?q=/en/", "/en/#x", "?u=/en/", "#/es/", "/EN/", "//en/"]
    urls = [f"{rnd.choice(['http', 'HTTPS', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(400)] + [None, "", "no scheme", "http:/x", "a://b://c/en/"] + ["http://com/en/" + "y" * 100_000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(url_filter.judge_urls(df))}
    assert got == {i: brute_rule(u, url_filter.RULES) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    rules = [url_filter.Rule(rnd.choice(["com", "b.com", "a.b.com", "net"]), rnd.choice(["", "/", "/x", "/x/y"]), rnd.choice(["allow", "block"])) for _ in range(40)]
    rules = list({(r.host, r.path): r for r in reversed(rules)}.values())
    many = [f"http://{rnd.choice(['com', 'q.com', 'b.com', 'z.a.b.com', 'net', 'xnet'])}{rnd.choice(['', '/', '/x', '/x/y/z'])}" for _ in range(300)]
    for hash_of in (url_filter.digest, lambda s: 5, lambda s: len(s) % 3):  # collisions decide nothing
        f = tmp_path / f"{id(hash_of)}"
        f.write_bytes(url_filter.pack(rules, hash_of))
        assert url_filter.Index(str(f), hash_of).judge(many) == [brute_rule(u, rules) for u in many]


def test_op8_takes_no_more_than_a_long_host(tmp_path):
    (tmp_path / "r").write_bytes(url_filter.pack(url_filter.RULES))
    index = url_filter.Index(str(tmp_path / "r"))
    host = "a." * 500_000 + "example.com"
    tracemalloc.start()
    got = index.judge([f"http://{host}/en/7", f"http://{'b' * 1_000_000}/", "http://a.xcom/en/", "http://x.com/en/"])
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()
    assert [g[2:] for g in got] == [("example.com/en/7", "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block")]


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage on its own input, and no stage loses a column."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "", "en", "s", 0), (90_002, "12 34 !!", "en", "s", 8), (90_003, None, None, None, None)], d.schema)
    d = d.union(extra).union(d.filter("doc_id = 3"))
    d.write.parquet(f"{tmp_path}/0")
    n, seen = {}, spark.read.parquet(f"{tmp_path}/0")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, sf)
        if k < 4:
            assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{k + 1}")
        before, seen = seen, spark.read.parquet(f"{tmp_path}/{k + 1}")
        n[name] = seen.count()
        if name == "language_id":
            assert not seen.filter("doc_id > 90000").count() and n[name] >= 195
        if name == "quality":
            scored = {r["doc_id"]: r["score"] for r in quality.classify(before, queries.table(spark, sf, "labels")).collect()}
            assert sorted({r["doc_id"] for r in seen.collect()}) == sorted(i for i, s in scored.items() if s >= corpus_pipeline.LEAST_QUALITY)
        if name == "exact_dedup":
            texts = [" ".join(r["text"].split()) for r in seen.collect()]
            assert len(texts) == len(set(texts)) == len({" ".join(r["text"].split()) for r in before.collect()})
        if name == "near_dedup":
            from segmill.llm.simhash import fingerprint

            fps = [fingerprint(r["text"]) for r in seen.collect()]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    assert {r["doc_id"] for r in seen.collect()} == {r["doc_id"] for r in before.collect()}


def test_pipeline_drops_only_copies(spark, sf):
    """Rows without doc_id, or with the same one, stay unless their texts are copies."""
    cols = spark.read.parquet(f"{sf}/documents.parquet").schema
    texts = [t * 20 for t in ("alpha beta gamma delta epsilon ", "one two three four five six ", "red green blue white black ", "north south east west up down ", "iron copper zinc tin lead gold ")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (9, texts[4]), (None, texts[4])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], cols).repartition(3)
    for stage in (corpus_pipeline.exact_dedup_stage, corpus_pipeline.near_dedup_stage):
        got = stage(spark, df, sf)
        assert got.columns == df.columns
        assert sorted(((r["doc_id"] or 0), texts.index(r["text"])) for r in got.collect()) == [(0, 0), (0, 1), (7, 2), (7, 3), (9, 4)]


def test_pipeline_on_odd_and_empty_documents(spark, sf):
    cols = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = spark.createDataFrame([(i, t, "en" if i else None, "s", len(t or "")) for i, t in ROWS], cols)
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert out.count() >= 0, name
    assert docs(spark).count() == len(ROWS) and empty(spark).count() == 0
