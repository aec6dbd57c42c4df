"""BPE by a deterministic automaton, built from the merges by successive gadgets.

The automaton reads tokens: its paths from the start are just the token sequences that BPE makes of
some byte string. It begins as one state with a loop for each byte. The gadget of a merge (a, b)
takes the state q that the arcs of a lead to: a copy of q without the arc b becomes the new target of
a, and each state with an arc a gets an arc ab to the target of b. After all merges, a word has one
path, as each pair of neighbours settles whether a token may follow another.

Rows of the transition table would take states x tokens. So the gadgets are kept as they were made:
what state a state was copied from and when, what arc it lost and when, and from which arc a token's
arcs were made. An entry of the table is read from these and remembered. This needs memory in
proportion to the merges only. As every beginning of a word has one path as well, a word is encoded in
one pass over its bytes, without search.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.llm.vocab import Vocab
from segmill.session import ship

#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 2_000_000


class Automaton:
    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], labels: list[bytes]):
        n = max([*base, *(m[2] for m in merges)]) + 1
        self.target = [0] * n  # the state that a token's arcs lead to
        self.made = [0] * n  # when a token got its arcs
        self.left = [-1] * n  # the token whose arcs it got them from
        self.live = [False] * n
        for t in base:
            self.live[t] = True
        self.origin, self.born = [-1], [0]
        self.lost: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        users = [len(base) + 1]  # tokens that lead to a state; the start is one more
        for k, (a, b, ab) in enumerate(merges, 1):
            if self.live[ab] or not (self.live[a] and self.live[b]):
                continue
            q, now = self.target[a], 2 * k
            if not self._has(q, b, now):
                continue  # no path has a before b: the merge never applies
            if users[q] > 1 or a == b:
                new = len(self.origin)
                self.origin.append(q)
                self.born.append(now)
                users.append(1)
                users[q] -= 1
                self.target[a] = new
                self.lost[new, b] = now
            else:
                new = q
                self.lost[q, b] = now
            self.left[ab], self.made[ab], self.live[ab] = a, now + 1, True
            self.target[ab] = q if a == b else self.target[b]
            users[self.target[ab]] += 1
        self.labels = labels
        self.prefixes: dict[bytes, int] = {}  # of the arcs' labels: the token, or -1 if it is none
        for t in range(n):
            if self.live[t]:
                self.prefixes[labels[t]] = t
                for k in range(1, len(labels[t])):
                    self.prefixes.setdefault(labels[t][:k], -1)

    def _has(self, state: int, token: int, now: int) -> bool:
        """Whether the state has an arc of the token, at that time."""
        while True:
            gone = self.lost.get((state, token))
            if gone is not None and gone <= now:
                return False
            if self.born[state] > self.made[token]:  # copied with or without the arc
                now, state = self.born[state], self.origin[state]
                if now == 0:
                    return True
            elif self.left[token] < 0:
                return True
            else:  # it got the arc if it had that of the left part
                now, token = self.made[token], self.left[token]

    def follows(self, state: int, token: int) -> bool:
        """The entry of the transition table, which is remembered."""
        got = self._has(state, token, 1 << 60)
        if len(self.known) >= MEMO:
            self.known.clear()
        self.known[state << 20 | token] = got
        return got

    def encode(self, word: bytes) -> list[int]:
        """The tokens on the word's only path. Each beginning of the word has just one path too, so one
        pass from left to right finds the state and the last token at each place by entries of the table,
        and ends once all places have theirs; the time is the word's length times the longest token's."""
        n = len(word)
        state, last = [-1] * (n + 1), [0] * (n + 1)
        state[0], open_ = 0, n
        known, target, get = self.known, self.target, self.prefixes.get
        for at in range(n):
            if (s := state[at]) < 0:
                raise ValueError("no path: a byte has no token")
            for end in range(at + 1, n + 1):
                t = get(word[at:end])
                if t is None:
                    break
                if t >= 0 and state[end] < 0:  # a place has one path: what has its token needs no other
                    got = known.get(s << 20 | t)
                    if got is None:
                        got = self.follows(s, t)
                    if got:
                        state[end], last[end] = target[t], t
                        open_ -= 1
            if not open_:
                break
        if state[n] < 0:
            raise ValueError("no path: a byte has no token")
        path = []
        while n:
            path.append(last[n])
            n -= len(self.labels[last[n]])
        return path[::-1]


class Codec:
    """Texts to ids and back. `most` bounds the worker's caches."""

    def __init__(self, path: str, most: int = 500_000):
        v = Vocab(path)
        if v.steps.get("type") != "ByteLevel" or not v.steps.get("use_regex", True) or v.steps.get("add_prefix_space") or v.normalizer or v.end or v.odd:
            raise ValueError("a byte-level file with the usual split pattern and plain special strings is expected")
        self.labels = v.labels
        self.automaton = Automaton(v.base.tolist(), v.merges, v.labels)
        self.words = regex.compile(PATTERN)
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in v.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.plain_gap = regex.compile(r" \s| $")
        self.most = most
        self.cache: dict[str, bytes] = {}  # chunks after a space, kept without it
        self.by_word: dict[str, bytes] = {}

    def _words(self, text: str) -> bytes:
        out = []
        for w in self.words.findall(text):
            got = self.by_word.get(w)
            if got is None:
                got = array("I", self.automaton.encode(w.encode())).tobytes()
                if len(w) <= 64:
                    if len(self.by_word) >= self.most:
                        self.by_word.clear()
                    self.by_word[w] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            return b"".join(self.special.get(s) or self._plain(s) for s in self.cut.split(text) if s)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """A single space before other than white space always begins a word, so what lies between
        such spaces is encoded by itself; a text with other runs of spaces is split as a whole."""
        if self.plain_gap.search(text):
            return self._words(text)
        first, *chunks = text.split(" ")
        cache = self.cache
        got = list(map(cache.get, chunks))
        if None in got:
            if len(cache) >= self.most:
                cache.clear()
            for k, v in enumerate(got):
                if v is None:
                    c = chunks[k]
                    got[k] = v = self._words(" " + c)
                    if len(c) <= 64:
                        cache[c] = v
        return self._words(first) + b"".join(got)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one after another, as UTF-8; what isn't UTF-8 becomes U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


if array("I", [1]).tobytes() != b"\x01\0\0\0":
    raise ImportError("ids are written in the machine's order, which must be little-endian with 32 bits")

_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with_ids also ids and decoded.

    Null and empty texts have no ids and decode to an empty text. Repeated rows give repeated rows; an
    empty table gives an empty result; other columns are ignored. Words of any length are encoded
    whole. A file whose steps before the merges are others than byte-level splitting raises an error.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for docs, texts in common.by_bytes(batches, 1, rows=200):
            ids = [c.encode(t) for t in texts]
            decoded = [c.decode(i) for i in ids]
            cols = [
                pa.array(docs, pa.int64()),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i in ids], pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)
