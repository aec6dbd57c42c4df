"""Vector codes, fill-in-middle, HyperMinHash near copies."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.llm import fill_in_middle, minhash, queries, vector_codes
from tests.llm.conftest import ROWS, docs, empty


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# Fill-in-middle.


@pytest.mark.parametrize("every,chunk", [(1, 1), (3, 5), (256, 1 << 20)])
def test_checkpoints_find_each_code_point(every, chunk):
    for text in ("", "abc", "äß€\U0001f600x" * 9, "́" * 4 + "a" * 30):
        index = fill_in_middle.Checkpoints(text.encode(), every, chunk)
        assert index.n == len(text)
        assert [index.byte(k) for k in range(len(text) + 2)] == [len(text[:k].encode()) for k in range(len(text) + 2)]


def plain_fim(doc_id, text):
    """The contract, over Python's strings."""
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


FIM = [*ROWS, *((100 + k, "aé€\U0001f600<S <P M>" * (1 + k % 5)) for k in range(60)), (300, "x<M>y"), (301, "<P>"), (302, "<"), (303, "S>"), (304, "€" * 70_000)]


def test_op12_against_strings_and_round_trip(spark):
    got = rows_of(fill_in_middle.restore(fill_in_middle.fill_in_middle(docs(spark, FIM).repartition(3))))
    want = sorted(((i, *plain_fim(i, t), t or "") for i, t in FIM), key=str)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=str) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_op12_rows(spark):
    got = rows_of(fill_in_middle.digests(docs(spark, FIM)))
    assert sorted((str(r["doc_id"]), r["output_sha256"], r["restored_sha256"]) for r in got) == sorted((str(i), sha(plain_fim(i, t)[4]), sha(t or "")) for i, t in FIM)
    assert fill_in_middle.digests(empty(spark)).count() == 0


def test_marks_that_begin_in_the_text_are_no_marks():
    for p, m, s in (("a<", "S>", "M>"), ("<S", "<", "P>b"), ("", "", "<"), ("<M", "<P", "<S")):
        text = (p + m + s).encode()
        for form, out in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
            assert fill_in_middle.put_back(out.encode(), form) == text


# Vector codes.


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract with whole distances, over numpy's whole numbers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}
    length = -(-max(len(v) for _, v, _ in kept) // parts)
    body = np.array([[math.floor(256 * x) for x in v] + [0] * (parts * length - len(v)) for _, v, _ in kept], np.int64).reshape(len(kept), parts, length)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = body[order].transpose(1, 0, 2).copy()

    def near():
        far = ((body[:, :, None, :] - books[None]) ** 2).sum(-1)
        return far.argmin(-1), far.min(-1)

    for _ in range(rounds):
        code, _ = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = body[code[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    code, far = near()
    error = far.sum(1)
    total = {}
    for (_, _, lab), e in zip(kept, error):
        total[lab] = total.get(lab, 0) + int(e)
    told = sha(",".join(str(x) for p in books for e in p for x in e.tolist()))
    return sorted(((i, "".join(f"{c:02x}" for c in cs), int(e), total[lab], told) for (i, _, lab), cs, e in zip(kept, code, error)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, salt int").repartition(3)


def coded(df, **how):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows_of(vector_codes.vector_codes(df, **how))), key=str)


def small(*xs):
    return [float(np.float32(x)) for x in xs]


def test_op11_on_odd_rows(spark):
    rnd = random.Random(4)
    rows = [(k, small(*(rnd.gauss(0, 0.2) for _ in range(32))), None if k % 7 == 0 else k % 3) for k in range(150)]
    rows += [(3, small(*([0.5] * 32)), 1), (None, small(*([-0.25] * 32)), 2), (200, None, 1), (201, [float("nan"), *[0.0] * 31], 1), (202, [float("inf"), *[0.0] * 31], 0), (203, [None, *[0.0] * 31], 0)]
    rows += [(204, small(1.0, -1.0), 0), (205, [], 0), rows[5], rows[5], (206, small(*([900.0] * 32)), 0)]
    assert coded(vectors(spark, rows)) == plain_codes(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)], [(5, [0.5] * 3, None), (4, [0.5] * 3, None)]])
def test_op11_on_small_tables(spark, rows):
    assert coded(vectors(spark, rows)) == (plain_codes(rows) or [])


def test_op11_ties_go_to_the_lower_entry(spark):
    rows = [(k, small(*[(k % 4) / 256] * 16), k % 2) for k in range(40)]
    assert coded(vectors(spark, rows), entries=8, rounds=3) == plain_codes(rows, entries=8, rounds=3)


def test_op11_says_so_if_errors_do_not_fit(spark):
    with pytest.raises(ValueError, match="beyond a long"):
        vector_codes.vector_codes(vectors(spark, [(1, [1e30] * 16, 1)]))


def test_bounds_are_kept_on_the_safe_side():
    x = np.concatenate([np.random.default_rng(1).random(5000) * 70_000, [0, 0.5, 1, 1.0625, 65535.9, 1e9]])
    back = vector_codes.unpack_bounds(vector_codes.pack_bounds(x))
    assert (back <= x).all() and (back[(x >= 1) & (x < 60_000)] > x[(x >= 1) & (x < 60_000)] * 0.93).all()


@pytest.mark.parametrize("scale", [3, 60, 1 << 20])
def test_bounds_lose_no_nearest_entry_and_save_work(scale):
    """Rounds from bounds give what whole distances do, ties included, and far entries are passed over."""
    rnd = np.random.default_rng(scale)
    x = rnd.integers(-scale, scale + 1, (600, 4)) + 8 * scale * rnd.integers(0, 4, (600, 1))
    books = [x[:40].copy()]
    for _ in range(3):
        books.append(books[-1] + rnd.integers(-scale // 8, scale // 8 + 1, (40, 4)))
    at, upper, lower, made = vector_codes.Book(books[0], None).first(x)
    for before, now in zip(books, books[1:]):
        at, upper, lower, made = vector_codes.Book(now, before).again(x, at, vector_codes._round_up(upper).astype(float), lower)
        far = ((x[:, None] - now) ** 2).sum(-1)
        assert (at == far.argmin(1)).all() and (upper**2 >= far.min(1) * (1 - 1e-12)).all()
        assert (vector_codes.unpack_bounds(lower) <= np.sqrt(far)).all()
        if scale < 1 << 16:  # beyond the bytes' range lower bounds exclude less
            assert made < far.size * 0.8


# HyperMinHash.


def plain_set(text, size=4):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_components(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)) if s else d, (low.get(find(i)) if s else d) == d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def copies(seed, groups=12, most=9):
    """Groups of edited copies, also chains of them, among texts that share passages."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    out = []
    for g in range(groups):
        words = [word() for _ in range(rnd.choice([3, 4, 6, 12, 40, 150]))] + (passage if g % 3 == 0 else [])
        for _ in range(rnd.randint(1, most)):
            out.append(" ".join(words) if rnd.random() < 0.5 else "\t".join(words).upper())
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = word()
    rnd.shuffle(out)
    return list(enumerate(out))


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(df)), key=str)


def test_op13_on_odd_rows(spark):
    rows = [*ROWS, (None, "lost id"), (None, "alone without an id"), (20, "ONE two\nthree four five six"), (21, "one two three four five six seven")]
    assert found(minhash.near_copies(docs(spark, rows).repartition(3))) == plain_components(rows)
    assert minhash.near_copies(empty(spark)).count() == 0


@pytest.mark.parametrize("seed,tile,tile_bytes", [(1, 2048, 1 << 24), (2, 3, 1 << 24), (3, 2048, 400), (4, 2, 200)])
def test_op13_against_all_pairs(spark, seed, tile, tile_bytes):
    """With small tiles groups and clusters are split, linked by heads and compared across tiles."""
    rows = copies(seed)
    assert found(minhash.near_copies(docs(spark, rows), tile=tile, tile_bytes=tile_bytes)) == plain_components(rows)


def test_op13_of_one_large_group(spark):
    """A third of all rows are near copies of one text, some too far from its first one to be linked to it directly."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for j in range(k % 60 // 2):
            words[(7 * j + k) % 120] = f"x{k}y{j}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"{rnd.random():.3f}" for _ in range(30))) for k in range(250)]
    assert found(minhash.near_copies(docs(spark, rows), tile=40)) == plain_components(rows)


def test_registers_are_least_hashes():
    rnd = np.random.default_rng(2)
    for n in (1, 5, 100, 3000):
        h = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        got = minhash.registers(h)
        by = {}
        for x in h.tolist():
            rest = (x << 7) & ((1 << 64) - 1)
            by[x >> 57] = min(by.get(x >> 57, 1 << 64), rest)
        for b, rest in by.items():
            zeros = 64 - rest.bit_length()
            after = (rest << (zeros + 1)) & ((1 << 64) - 1)
            assert got[b] == min(zeros, 63) << 10 | after >> 54
        assert set(got.tolist()) == {int(got[b]) for b in by}


def test_registers_estimate_jaccard():
    rnd = np.random.default_rng(3)
    for n, want in ((10, 0.8), (200, 0.8), (2000, 0.5), (2000, 0.0)):
        errors = []
        for _ in range(60):
            h = np.unique(rnd.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2))
            both = round(2 * n * want / (1 + want))
            a, b = np.sort(h[rnd.permutation(len(h))][: 2 * n - both]), None
            a, b = a[rnd.permutation(len(a))], None
            x, y = np.sort(a[:n]), np.sort(a[n - both :])
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            same = (minhash.registers(x) == minhash.registers(y)).sum()
            errors.append(float(minhash.estimate(np.array([same]), np.array([len(x)]), np.array([len(y)]))[0]) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12, (n, want)


def test_pairs_of_a_similarity_of_80_share_a_band():
    """Of 3,000 pairs at the bound none is missed, for sets of a few up to some hundred shingles."""
    rnd = np.random.default_rng(5)
    missed = 0
    for k in range(3000):
        n = int(rnd.choice([4, 8, 40, 160, 400]))
        h = np.unique(rnd.integers(0, 1 << 63, 5 * n // 4, dtype=np.uint64) * np.uint64(2))
        x, y = minhash.registers(h), minhash.registers(np.sort(rnd.choice(h, len(h) * 4 // 5, replace=False)))
        missed += not (x.view(np.int64) == y.view(np.int64)).any()
    assert not missed


def test_new_queries_read_whole_tables(spark, sf):
    for name, table in (("op11_elkan_codes", "embeddings"), ("op12_fill_in_middle", "documents"), ("op13_hyperminhash", "documents")):
        assert queries.QUERIES[name](spark, sf).count() == queries.table(spark, sf, table).count()
    d = queries.table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    assert found(queries.op13_hyperminhash(spark, sf)) == plain_components(rows)
    assert d.filter(F.col("text").isNull()).count() == 0


# Near copies of the pipeline, and promises of the classifiers.


def test_near_groups_drop_only_near_copies(spark):
    """Every link found is one on the sets, and nearly all links are found."""
    from segmill.llm import near_text

    rows = [(i, t) for i, t in copies(11, 30, 6) if len(t.split()) > 8]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, node int").repartition(3)
    group = {r["doc_id"]: r["group"] for r in near_text.near_groups(df).collect()}
    sets = {i: plain_set(t, 5) for i, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    links = [(a, b) for a in sets for b in sets if a < b and near(a, b)]
    assert sum(group.get(a) == group.get(b) is not None for a, b in links) >= 0.9 * len(links) and len(links) > 30
    for i, g in group.items():
        assert any(j != i and group[j] == g and near(i, j) for j in group) and min(j for j in group if group[j] == g) == g
    assert near_text.near_groups(df.limit(0)).count() == 0


def test_tables_that_grow_with_the_input_are_not_broadcast(spark):
    """Spark takes 36 keys a row for one, so the table of keys would be gathered on the driver."""
    import corpus_pipeline
    from segmill.llm import common

    one = spark.range(200).select(F.col("id").alias("fp"), (F.col("id") % 7).alias("node"))  # a table whose size Spark knows
    keyed = one.select("node", "fp", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("key"))
    for df in (common.with_least(keyed, ["key"], "fp", "fp"), corpus_pipeline._only(one, keyed.select("fp"), "fp", "left_anti")):
        df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    got = common.with_least(keyed, ["key"], "fp", "fp").select("least", "members").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 200)]


def test_equal_texts_score_equally_in_any_batch(spark, sf):
    from segmill.llm import language_id, quality

    d = queries.table(spark, sf, "documents")
    texts = [r["text"] for r in d.orderBy("doc_id").select("text").collect()][:101]
    q = quality.fit(d, queries.table(spark, sf, "labels"))
    lang = language_id.fit(d)
    for t in texts[:12]:
        some = [t, *texts[:100], t]
        for size in (1, 2, 7, 33, 102):
            batches = [some[i : i + size] for i in range(0, len(some), size)]
            assert len({q.score(b)[k] for b in batches for k, x in enumerate(b) if x == t}) == 1
            assert len({(x, s) for b in batches for x, s, y in zip(*lang.predict(b), b) if y == t}) == 1


def test_automaton_wants_a_byte_level_file(tmp_path):
    import json

    import public_tokenizers

    from segmill.llm import bpe_automaton

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for key, value in (("pre_tokenizer", {"type": "Whitespace"}), ("normalizer", {"type": "NFC"}), ("added_tokens", [dict(spec["added_tokens"][0], lstrip=True)])):
        with open(path := f"{tmp_path}/{key}.json", "w") as f:
            json.dump(spec | {key: value}, f)
        with pytest.raises(ValueError):
            bpe_automaton.Codec(path)


def test_special_strings_need_no_bracket(tmp_path):
    import json

    import public_tokenizers
    import tokenizers

    from segmill.llm import bpe_automaton

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"] = [dict(spec["added_tokens"][0], content="[end]", id=50256)]
    spec["model"]["vocab"].pop("<|endoftext|>", None)
    spec["model"]["vocab"]["[end]"] = 50256
    with open(path := f"{tmp_path}/t.json", "w") as f:
        json.dump(spec, f)
    t = tokenizers.Tokenizer.from_file(path)
    for text in ("a [end] b", "[end][end]", "no end"):
        assert np.frombuffer(bpe_automaton.Codec(path).encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pipeline_keeps_columns_of_any_name(spark, sf):
    import corpus_pipeline

    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (2, text + " more"), (2, "another text of its own, a few words long"), (None, text.upper()), (5, text + " more")]
    cols = "doc_id long, text string, lang string, source string, n_chars long, _row string, _kept int, row_key string, Other_Key long, n int"
    df = spark.createDataFrame([(i, t, "en", "s", len(t), f"r{k}", k, f"k{k}", k, k) for k, (i, t) in enumerate(rows)], cols).repartition(2)
    exact = corpus_pipeline.exact_dedup_stage(spark, df, sf)
    near = corpus_pipeline.near_dedup_stage(spark, exact, sf)
    assert exact.columns == near.columns == df.columns
    assert sorted((r["_row"], r["_kept"], r["row_key"], r["Other_Key"]) for r in exact.collect()) == [(f"r{k}", k, f"k{k}", k) for k in (0, 1, 2, 3)]
    assert sorted(r["_row"] for r in near.collect()) == ["r0", "r2"]
