"""Packing by lexical retrieval: windows are filled with the neighbours of a seed document.

Two passes make shards by content, and a sort deals them out:

1. Texts become ids, written once to the shared folder; each task adds the document frequencies and
   lengths of its rows, and these are summed over all tasks.
2. A document's key is its KEY_TERMS terms of highest BM25 weight that another document has too, the
   most frequent first. Documents are dealt out and sorted by key, so those that share such terms are
   neighbours wherever they were stored. A shard is a run of this order, at most SHARD_DOCS and about
   SHARD_TOKENS ids.

The order ends with the row's own number, so neither a common key nor a large group of copies can
make a shard or a task larger. A task has many shards (PART_TOKENS ids), and a run too small for a window
goes to the run before.

A shard has an inverted index of its documents with BM25 weights; a seed document's terms return its
unused neighbours by score, and these fill the seed's window in that order. The document that no
longer fits is cut, and its rest is the seed of the next window. So each window has exactly WINDOW
ids. What a shard is left with is cut into sequences of powers of two, which take no padding. All
rows and all ids are packed. Neighbours that share no leading term may still be in different shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common, vocab
from segmill.session import materialize, ship

WINDOW = 4096
END = 2
SHARD_DOCS = 1024
SHARD_TOKENS = 4 << 20
#: Ids of a task, and the most tasks; beyond them tasks grow, shards don't.
PART_TOKENS = 16 << 20
MOST_PARTS = 50_000
MOST_DOCS = 30_000
KEY_TERMS = 8
K1, B = 1.2, 0.75


class Corpus(NamedTuple):
    """What BM25 takes from all documents."""

    n: int
    ids: int
    df: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - self.df[terms] + 0.5) / (self.df[terms] + 0.5))

    def norm(self, size):
        return K1 * (1 - B + B * size / max(self.ids / max(self.n, 1), 1.0))

    def weights(self, terms: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.idf(terms) * tf * (K1 + 1) / (tf + self.norm(size))

    def keys(self, docs: list[np.ndarray]) -> list[bytes]:
        """For each document its heaviest terms that others have too, the most frequent first; keys sort as bytes."""
        doc, terms, tf = postings(docs)
        shared = self.df[terms] > 1
        doc, terms, tf = doc[shared], terms[shared], tf[shared]
        size = np.array([len(d) for d in docs])
        weight = self.weights(terms, tf, size[doc])
        ends = np.searchsorted(doc, np.arange(len(docs) + 1)).tolist()
        out = []
        for a, b in zip(ends, ends[1:]):
            top = terms[a:b]
            if b - a > KEY_TERMS:
                top = top[np.argpartition(-weight[a:b], KEY_TERMS - 1)[:KEY_TERMS]]
            out.append(top[np.lexsort((top, -self.df[top]))].astype(">u2").tobytes())
        return out


def postings(docs: list[np.ndarray], by_term: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of all terms of all documents by one sort; ids and documents take 16 bits."""
    if len(docs) >= 1 << 16:
        raise ValueError("too many documents at once")
    of = np.repeat(np.arange(len(docs), dtype=np.uint32), [len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    both = np.sort(ids << np.uint32(16) | of if by_term else of << np.uint32(16) | ids)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    tf = np.diff(np.append(at, len(both)))
    high, low = (both[at] >> np.uint32(16)).astype(np.int64), (both[at] & np.uint32(0xFFFF)).astype(np.int64)
    return (low, high, tf) if by_term else (high, low, tf)


def corpus_of(docs: list[np.ndarray]) -> Corpus:
    return Corpus(len(docs), sum(map(len, docs)), np.bincount(postings(docs)[1]))


class Index:
    """BM25 over the ids of a shard; frequencies and the mean length are those of the corpus.

    A term has a posting list of (document, weight); that of a term in at least one of DENSE documents
    is a row of weights.
    """

    DENSE = 8

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        self.n = len(docs)
        self.doc, terms, tf = postings(docs, by_term=True)
        size = np.array([len(d) for d in docs], np.float64)
        self.weight = corpus.weights(terms, tf, size[self.doc])
        known, start, df = np.unique(terms, return_index=True, return_counts=True)
        self.start = np.append(start, len(terms))
        number = np.repeat(np.arange(len(known)), df)  # of each posting's term
        order = np.argsort(self.doc, kind="stable")
        ends = np.searchsorted(self.doc[order], np.arange(self.n + 1))
        self.terms = [number[order[a:b]] for a, b in zip(ends, ends[1:])]
        self.row = np.full(len(known), -1)
        many = np.flatnonzero(df * self.DENSE >= self.n)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), self.n), np.float32)
        own = self.row[number] >= 0
        self.rows[self.row[number[own]], self.doc[own]] = self.weight[own]

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents of the shard for the seed's terms."""
        at = self.terms[seed]
        row = self.row[at]
        out = self.rows[row[row >= 0]].sum(0)
        at = at[row < 0]
        lo = self.start[at]
        size = self.start[at + 1] - lo
        some = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        return out + np.bincount(self.doc[some], self.weight[some], self.n)


def pack(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length); each but the last few fills a window.
    Without a corpus the documents are all there are."""
    size = np.array([len(d) for d in docs])
    unused = np.ones(len(docs), bool)
    index: Index | None = None
    order = iter(np.lexsort((np.arange(len(docs)), -size)).tolist())  # the longest are seeds first
    left = int(size.sum())
    seed, at = -1, 0  # the document under way, and its ids already placed
    while left >= window:
        if seed < 0:
            seed, at = next(k for k in order if unused[k]), 0
            unused[seed] = False
        pieces, room, query = [], window, seed
        score: np.ndarray | None = None
        while True:
            take = min(room, int(size[seed]) - at)
            pieces.append((seed, at, take))
            at += take
            room -= take
            if at == size[seed]:
                seed, at = -1, 0
            if not room:
                break
            if score is None:
                index = index or Index(docs, corpus or corpus_of(docs))
                score = index.scores(query)
                score[~unused] = -1.0
            seed = int(score.argmax())  # the first of the best
            score[seed], unused[seed] = -1.0, False
        left -= window
        yield pieces
    rest: list[tuple[int, int, int]] = [(seed, at, int(size[seed]) - at)] if seed >= 0 else []
    rest += [(k, 0, int(size[k])) for k in np.flatnonzero(unused).tolist()]
    while left:
        room, pieces = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            doc, start, length = rest.pop(0)
            take = min(room, length)
            pieces.append((doc, start, take))
            room -= take
            if take < length:
                rest.insert(0, (doc, start + take, length - take))
        yield pieces


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

IDS = "row long, doc_id long, ids binary"
_IDS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
#: At most so many tasks add up the counts of all others.
ADDERS = 1000


def _arrays(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in texts]


def _write_ids(df: DataFrame, path: str, end: int) -> DataFrame:
    """Each row with a number of its own and its ids, read from one writing. Each task's last row, with
    the number -1, has what BM25 needs of its documents: how many have each term, their number and
    that of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocab.word_tokens(path)
        row = common.partition_id() << 36
        tail = np.array([end], "<u2").tobytes()
        df, n, total = np.zeros(1 << 16, np.int64), 0, 0
        for some, texts in common.by_bytes(batches, 1):
            ids = [got + tail for got in words.encode(texts, "<u2")]
            docs = _arrays(ids)
            df += np.bincount(postings(docs)[1], minlength=len(df))
            n, total = n + len(docs), total + sum(map(len, docs))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(ids)), pa.int64()), pa.array(some, pa.int64()), pa.array(ids, pa.binary())], schema=_IDS)
            row += len(ids)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([np.append(df, [n, total]).astype("<i8").tobytes()], pa.binary())], schema=_IDS)

    return materialize(df.mapInArrow(run, IDS))


def _count_terms(written: DataFrame) -> Corpus:
    """Over all documents: the sum of the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << 16) + 2, np.int64)
        for (some,) in common.rows(batches, 16):
            for x in some:
                total += np.frombuffer(x, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    found = written.filter("row < 0").select("ids").coalesce(ADDERS).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((1 << 16) + 2, np.int64)
    for r in found:
        total[r["term"]] = r["n"]
    return Corpus(int(total[-2]), int(total[-1]), total[:-2])


def _by_content(written: DataFrame, corpus, total: int, part_tokens: int) -> DataFrame:
    """(doc_id, ids) dealt out and sorted by key. Rows and keys are written before, so that finding the
    bounds of the ranges reads them without making them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                some = b.slice(i, 1024)
                keys = corpus.value.keys(_arrays(some.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *some.columns], names=["key", "row", "doc_id", "ids"])

    keyed = materialize(written.filter("row >= 0").mapInArrow(run, "key binary, " + IDS))
    parts = min(max(1, -(-total // part_tokens)), MOST_PARTS)
    return keyed.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").select("doc_id", "ids")


def pack_documents(
    df: DataFrame, path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text",
    shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS, part_tokens: int = PART_TOKENS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with_ids also the ids.

    A document is its ids and then `end`; null and empty texts are just `end`. Repeated rows are
    packed once each. An empty table gives an empty result; other columns are ignored. sequence_id
    counts up within the task, whose number it has in its upper bits.
    """
    spark = df.sparkSession
    ship(spark)
    written = _write_ids(common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text"), path, end)
    counts = _count_terms(written)
    corpus = spark.sparkContext.broadcast(counts)  # a number for each entry of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        seq = common.partition_id() << 32

        def shard(ids: list[int | None], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            out: list[tuple] = []
            for pieces in pack(docs, window, corpus.value):
                offset = 0
                for k, start, length in pieces:
                    own = docs[k][start : start + length].astype("<u4")
                    out.append((ids[k], start, length, zlib.crc32(own), len(docs[k]), seq, offset, *([own] * with_ids)))
                    offset += length
                seq += 1
            cols = list(zip(*out))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array([x.astype(np.int64) for x in c], pa.list_(pa.int64())) for c in cols[7:]]
            yield pa.RecordBatch.from_arrays(arrays, names=_NAMES + ["ids"] * with_ids)

        full: tuple[list, list] = [], []  # the shard before, until what follows fills a window
        ids: list[int | None] = []
        docs: list[np.ndarray] = []
        held = 0
        for some, texts in common.by_bytes(batches, 1):
            for doc, got in zip(some, _arrays(texts)):
                ids.append(doc)
                docs.append(got)
                held += len(got)
                if held >= window and full[0]:
                    yield from shard(*full)
                    full = [], []
                if held >= window and (len(docs) >= shard_docs or held >= shard_tokens):
                    full, ids, docs, held = (ids, docs), [], [], 0
                elif len(docs) >= MOST_DOCS:  # very many documents of a few ids
                    yield from shard(full[0] + ids, full[1] + docs)
                    full, ids, docs, held = ([], []), [], [], 0
        if full[0] or docs:
            yield from shard(full[0] + ids, full[1] + docs)

    ddl = OUT + ", ids array<long>" * with_ids
    return _by_content(written, corpus, counts.ids, part_tokens).mapInArrow(run, ddl)
