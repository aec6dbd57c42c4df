"""Automaton, token counts, packing, exact dedup, SimHash, sampling: against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segmill.llm import bpe_automaton, exact_dedup, packing, queries, simhash, token_counts, vocab, weighted_sampling
from segmill.llm.components import components
from tests.llm.conftest import ROWS, docs, empty


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(queries.tokenizer(queries.BYTE_BPE))


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(queries.tokenizer(queries.WORD_BPE))


def strings(n, seed):
    rnd = random.Random(seed)
    odd = [chr(c) for c in [*range(0, 0x250), 0x2028, 0x200B, 0x3000, 0x1680, 0x301, 0x130, 0x3A3, 0x1E9E, 0xAC00, 0x1100, 0x1161, 0xFB01, 0x216F, 0x1F600, 0x660]]
    parts = ["the", "ing", " ", "  ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "\n", "12", "³", "E", "tion", "aaaa"]
    return ["".join(rnd.choice(odd) if rnd.random() < 0.4 else rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(n)]


def test_automaton_gives_the_library_ids(byte_bpe):
    c = bpe_automaton.Codec(queries.tokenizer(queries.BYTE_BPE))
    for s in strings(1500, 1):
        ids = byte_bpe.encode(s, add_special_tokens=False).ids
        got = c.encode(s)
        assert got == u32(ids), repr(s)
        assert c.decode(got) == byte_bpe.decode(ids, skip_special_tokens=False)


def test_automaton_of_small_merges_is_exact():
    """All words up to seven bytes, against merging pair by pair."""
    rnd = random.Random(3)
    for _ in range(60):
        labels, merges = [bytes([97 + i]) for i in range(3)], []
        for _ in range(8):
            a, b = rnd.randrange(len(labels)), rnd.randrange(len(labels))
            if labels[a] + labels[b] not in labels:
                merges.append((a, b, len(labels)))
                labels.append(labels[a] + labels[b])
        m = bpe_automaton.Automaton([0, 1, 2], merges, labels)
        for _ in range(120):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 8)))
            want = [x - 97 for x in word]
            for a, b, ab in merges:
                i = 0
                while i < len(want) - 1:
                    if want[i] == a and want[i + 1] == b:
                        want[i : i + 2] = [ab]
                    i += 1
            assert m.encode(word) == want, (merges, word)


def test_op2_rows(spark, byte_bpe):
    got = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in rows_of(bpe_automaton.encode_decode(docs(spark), queries.tokenizer(queries.BYTE_BPE)))}
    want = set()
    for i, t in ROWS:
        ids = byte_bpe.encode(t or "", add_special_tokens=False).ids
        want.add((i, hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(byte_bpe.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)))
    assert got == want
    assert bpe_automaton.encode_decode(empty(spark), queries.tokenizer(queries.BYTE_BPE)).count() == 0


def test_word_ids_equal_the_library(word_bpe):
    w = vocab.WordTokens(queries.tokenizer(queries.WORD_BPE), most=500)  # small caches, so they are emptied too
    texts = strings(2000, 2)
    for i in range(0, len(texts), 50):
        for s, ids in zip(texts[i : i + 50], w.encode(texts[i : i + 50])):
            assert ids == u32(word_bpe.encode(s, add_special_tokens=False).ids), repr(s)


def test_word_ids_of_long_texts_and_words(word_bpe, monkeypatch):
    """Texts cut at white space, words beyond what the store keeps, and other alphabets."""
    monkeypatch.setattr(vocab.WordTokens, "STEP", 40)
    w = vocab.WordTokens(queries.tokenizer(queries.WORD_BPE), most=50)
    texts = ["Ab1 " * 100, "x" * 300 + " Y", None, "", "\u65e5\u672c\u8a9e\u3000" * 30, "don't'll 'S <|endoftext|>tail" * 9, "\x1f\x1cA b\x85c" * 20, "\u0130stanbul \u03a3\u03a3 " * 9, "'" * 99]
    assert w.encode(texts) == [u32(word_bpe.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_equal_ids_beyond_the_first_arrays():
    """More words than the store begins with, some in the table of lengths, some odd."""
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("abcdeé'3日") for _ in range(rnd.randrange(1, 9))) for _ in range(400)) for _ in range(150)]
    w = vocab.WordTokens(queries.tokenizer(queries.WORD_BPE))
    known = [b for b, _ in w.pre_tokens(texts[0]).most_common(100)]
    assert w.count([*texts, None], vocab.Lengths(w.lengths(known))).tolist() == [*(len(x) // 4 for x in w.encode(texts)), 0]
    assert len(w.known) > 1 << 14


def test_lengths_confirm_bytes_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(vocab.Lengths, "hashes", staticmethod(lambda words: np.array([len(w) for w in words], np.uint64)))
    words = [b"a", b"b", b"cc", b"dd", b"eee"]
    t = vocab.Lengths({w: k for k, w in enumerate(words, 1)})
    asked = [b"dd", b"x", b"b", b"eee", b"zz", b"a", b"cc"]
    assert t.probe(pa.array(asked, pa.binary()), asked).tolist() == [4, -1, 2, 5, -1, 1, 3]
    assert vocab.Lengths({}).probe(pa.array(asked, pa.binary()), asked).tolist() == [-1] * 7


def test_packing_scores_equal_bm25_term_by_term():
    rnd = np.random.default_rng(5)
    docs_ = [rnd.zipf(1.4, rnd.integers(1, 60)).clip(0, 300).astype("<u2") for _ in range(40)]
    corpus = packing.corpus_of(docs_)
    index = packing.Index(docs_, corpus)
    mean = sum(map(len, docs_)) / len(docs_)
    df = Counter(t for d in docs_ for t in set(d.tolist()))
    for seed in range(40):
        want = []
        for d in docs_:
            tf = Counter(d.tolist())
            want.append(sum(np.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs_[seed].tolist()) if t in tf))
        assert np.allclose(index.scores(seed), want, rtol=1e-5)


def test_op10_rows(spark, word_bpe):
    path = queries.tokenizer(queries.WORD_BPE)
    for table in (0, 5, 1000):  # the broadcast table changes nothing
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows_of(token_counts.count_tokens(docs(spark), path, table=table)))
        want = Counter()
        for i, t in ROWS:
            n = len(word_bpe.encode(t or "", add_special_tokens=False).ids)
            want[i, len((t or "").encode()), n, n > 2048] += 1
        assert got == want
    assert token_counts.count_tokens(empty(spark), path).count() == 0


@pytest.mark.parametrize("window,shard", [(4096, 1024), (64, 5)])
def test_op5_packs_each_id_once(spark, word_bpe, window, shard):
    path = queries.tokenizer(queries.WORD_BPE)
    got = rows_of(packing.pack_documents(docs(spark).coalesce(1), path, window=window, shard_docs=shard))
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window and at & (at - 1) == 0
    want = Counter()
    for i, t in ROWS:
        want[i, len(word_bpe.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    assert sum(r["length"] for r in got) == sum(n * k for (_, n), k in want.items())
    ids_of = {i: u32(word_bpe.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ROWS}
    for r in got:
        own = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(own) // 4
        assert r["ids_crc32"] == zlib.crc32(own[4 * r["start"] : 4 * (r["start"] + r["length"])])
    starts = Counter((r["doc_id"], r["start"]) for r in got)
    assert all(starts[i, 0] == sum(k for (j, _), k in want.items() if j == i) for i, _ in ROWS)
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_packing_takes_neighbours():
    """A window is filled with the documents that share words with its seed."""
    a = [np.array([1, 2, 3, 4, 5, k], "<u4") for k in range(10, 14)]
    b = [np.array([91, 92, 93, 94, 95, k], "<u4") for k in range(20, 24)]
    mixed = [x for pair in zip(a, b) for x in pair]
    first = next(packing.pack(mixed, 24))
    assert {k % 2 for k, _, _ in first} == {0} or {k % 2 for k, _, _ in first} == {1}


def test_op5_finds_neighbours_of_other_tasks(spark):
    """Related documents that are far apart in the table share windows, and no small partition is left on its own."""
    topics = ["alpha beta gamma delta", "one two three four", "red green blue white", "north south east west"]
    rows = [(k, topics[k % 4] + " text" * (k % 3)) for k in range(160)]
    df = docs(spark, rows).repartition(16, "doc_id")
    got = rows_of(packing.pack_documents(df, queries.tokenizer(queries.WORD_BPE), window=32, shard_docs=40))
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
    full = [own for own in seqs.values() if sum(r["length"] for r in own) == 32]
    assert sum(len({r["doc_id"] % 4 for r in own}) == 1 for own in full) >= 0.8 * len(full)
    assert sum(r["length"] for own in full for r in own) >= 0.9 * sum(r["length"] for r in got)


def test_op5_counts_terms_of_all_documents(spark, word_bpe):
    df = docs(spark).repartition(5)
    path = queries.tokenizer(queries.WORD_BPE)
    got = packing._count_terms(packing._write_ids(df.select("doc_id", "text"), path, 2))
    own = [word_bpe.encode(t or "", add_special_tokens=False).ids + [2] for _, t in ROWS]
    want = Counter(k for ids in own for k in set(ids))
    assert (got.n, got.ids) == (len(own), sum(map(len, own)))
    assert {k: int(got.df[k]) for k in np.flatnonzero(got.df).tolist()} == want


def brute_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    return out, len(groups)


@pytest.mark.parametrize("bucket", [1 << 26, 300])
def test_op4_against_brute_force(spark, bucket, monkeypatch):
    got = rows_of(exact_dedup.exact_dedup(docs(spark).repartition(3)))
    want, groups = brute_dedup(ROWS)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_grace_recursion_and_collisions():
    rnd = random.Random(5)
    texts = [str(rnd.randrange(40)).encode() * rnd.randrange(1, 4) for _ in range(600)]
    same = 77  # all hashes equal: only contents tell them apart
    for h in (lambda t: xxhash.xxh64_intdigest(t), lambda t: same):
        rows = [(h(t), g, 1000 - g, 1, t) for g, t in enumerate(texts)]
        got = {v[0]: v[1:] for v in exact_dedup.grace(rows, most=500)}
        low = {}
        for g, t in enumerate(texts):
            low[t] = min(low.get(t, (9999, 0)), (1000 - g, g))
        size = Counter(texts)
        assert got == {g: (*low[t], size[t]) for g, t in enumerate(texts)}


@pytest.mark.parametrize("h", [lambda k: 9, lambda k: k])
def test_grace_holds_equal_contents_once(h):
    """A thousand rows of one text of a megabyte, among others, within 8 MB."""
    text = b"x" * (1 << 20)
    rows = ((h(k % 3), k, k, 1, bytes(text) if k % 3 else b"%d" % k * 200) for k in range(1500))
    tracemalloc.start()
    got = {v[0]: v[1:] for v in exact_dedup.grace(rows, most=4 << 20)}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20
    if h(1) == h(2):
        assert {v for g, v in got.items() if g % 3} == {(1, 1, 1000)}
    else:
        assert {v for g, v in got.items() if g % 3} == {(1, 1, 500), (2, 2, 500)}
    assert all(got[g] == (g, g, 1) for g in range(0, 1500, 3))


def brute_fp(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_op6_against_brute_force(spark):
    top = (1 << 63) - 1
    rows = [*ROWS, (top, "the last id of all"), (None, "a text without id"), (None, "a text without id")] + [(None if k % 2 else 100 + k, [None, " ", "..."][k % 3]) for k in range(40)]
    got = rows_of(simhash.simhash_groups(docs(spark, rows)))
    fps = [brute_fp(t) for _, t in rows]
    roots = brute_components(fps)
    want = Counter()
    for (i, _), f, r in zip(rows, fps, roots):
        want[i, f"{f:016x}", min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None)] += 1
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.simhash_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("tile,radius,blocks", [(2048, 2, None), (4, 2, None), (2048, 6, None), (30, 6, None), (2048, 5, 9)])
def test_links_of_close_fingerprints(spark, tile, radius, blocks):
    """Chains of small steps, groups beyond a tile among them."""
    rnd = random.Random(9)
    fps = []
    for _ in range(12):
        f = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 14)):
            fps.append(f)
            for _ in range(rnd.randrange(1, 4)):
                f ^= 1 << rnd.randrange(64)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    found = {r["node"]: r["component"] for r in components(simhash.links(nodes, radius, tile, blocks)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps, radius)


def test_links_without_large_groups_plan_no_joins(spark, capsys):
    nodes = spark.range(40).select(F.col("id").alias("node"), F.col("id").alias("fp"))
    for tile, joins in ((64, False), (4, True)):
        capsys.readouterr()
        simhash.links(nodes, 2, tile).explain()
        assert ("Join" in capsys.readouterr().out) == joins


def test_groups_across_batches():
    """Groups that go on from one batch to the next are seen whole, small and large ones."""
    rnd = random.Random(3)
    rows = sorted((rnd.randrange(3), rnd.randrange(4), rnd.randrange(2), 0, k, rnd.getrandbits(5)) for k in range(300))
    rows += [(9, 0, 0, 0, 1000 + k, k) for k in range(40)] + [(9, 1, 0, 0, 2000, 0)]
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=list("abcdef")) for i in range(0, len(rows), size)]
        got, seen = [], 0
        for starts, _, node, fp in simhash._groups(batches):
            seen += len(node)
            for i, j in simhash.near_in_groups(starts, fp.view(np.uint64), 1):
                got += zip(node[i].tolist(), node[j].tolist())
        assert seen == len(rows) and list(simhash._groups([])) == []
        by = {}
        for *key, _, node, fp in rows:
            by.setdefault(tuple(key), []).append((node, fp))
        links = lambda own: {frozenset((a, b)) for a, x in own for b, y in own if a != b and (x ^ y).bit_count() <= 1}
        want = {p for own in by.values() for p in links(own)}
        got = {frozenset(p) for p in got}
        small = {p for own in by.values() if len(own) <= simhash.SMALL for p in links(own)}
        assert small <= got <= want
        root = lambda pairs: {frozenset(c) for c in _classes(pairs)}
        assert root(got) == root(want)


def _classes(pairs):
    of = {}
    for p in pairs:
        whole = set().union(p, *(of.get(x, ()) for x in p))
        for x in whole:
            of[x] = whole
    return of.values()


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (560, 501)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 200} == {k: 100 for k in range(100, 161)}
    assert {v for k, v in got.items() if k >= 500} == {500}


def shingles(t, n=5):
    w = (t or "").split()
    n = min(n, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter(["none"])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_op9_rows(spark):
    """Null and repeated ids too; those beyond a range's size are ordered by a hash of the text."""
    s = weighted_sampling.Sampler()
    hot = [(k % 2 and 20 or None, f"text number {k % 40} of many") for k in range(60)]
    for rows, parts in ((ROWS, 1), (ROWS, 4), (ROWS, 30), (ROWS + hot, 1), (ROWS + hot, 12)):
        got = rows_of(weighted_sampling.edited_likeness(docs(spark, rows).repartition(3), parts=parts))
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
        order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        if parts == 12:
            hashes = spark.createDataFrame([(t,) for _, t in order], "t string").selectExpr("t", "xxhash64(t) AS h").collect()
            h = {r["t"]: r["h"] for r in hashes}
            cuts = {i: -(-n // (len(rows) // parts)) for i, n in Counter(i for i, _ in order).items()}
            place = lambda i, t: (h[t] % cuts[i], h[t]) if cuts[i] > 1 else (0, 0)
            order.sort(key=lambda x: (x[0] is not None, x[0] or 0, place(*x), x[1]))
        want = Counter()
        for k, (i, t) in enumerate(order):
            nxt = order[(k + 1) % len(order)][1]
            q = len(t) // 4
            edited = t[: len(t) - q] + nxt[:q]
            a, b, c = (s.fingerprint(x) for x in (t, edited, nxt))
            want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), weighted_sampling.show(a), weighted_sampling.show(b), float((a == b).mean()), float((a == c).mean())] += 1
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        assert Counter(tuple(r[n] for n in names) for r in got) == want
    assert weighted_sampling.edited_likeness(empty(spark)).count() == 0
    one = rows_of(weighted_sampling.edited_likeness(docs(spark, [(3, "a b c d e f g h")])))
    assert one[0]["near_next"] == 1.0


def test_sampling_estimates_generalised_jaccard():
    rnd = random.Random(4)
    s = weighted_sampling.Sampler(samples=1024)
    words = [f"w{i}" for i in range(8)]
    for n in (40, 200):
        a = " ".join(rnd.choice(words[:3]) for _ in range(n))
        b = a[: len(a) // 2] + " " + " ".join(rnd.choice(words[:3]) for _ in range(n // 2))
        j = jaccard(shingles(a), shingles(b))  # few words, so weights above one occur
        assert max(shingles(a).values()) > 1
        assert abs(weighted_sampling.likeness(s.fingerprint(a), s.fingerprint(b)) - j) < 0.07
        both = s.pair(a, b)
        assert (both[0] == s.fingerprint(a)).all() and (both[1] == s.fingerprint(b)).all()
    for a, following in (("one two three four five six", "7 8"), ("ab cd", "x y"), ("", "x"), (" a  b c d ", ""), ("word" * 9, "s t")):
        b = weighted_sampling.edit(a, following)
        both = s.pair(a, b, len(a) - len(a) // 4)
        assert (both[0] == s.fingerprint(a)).all() and (both[1] == s.fingerprint(b)).all()
