"""Reading a tokenizer file, and encoding many words at once by array operations."""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task uses one core

NONE = np.int32(2**31 - 1)
PAD = np.uint16(2**16 - 1)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print as
    themselves keep their place, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


class Vocab:
    """Base symbols, merges and labels of a BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("a plain BPE model is expected")
        ids: dict[str, int] = model["vocab"]
        self.ids, self.end = ids, model.get("end_of_word_suffix") or ""
        self.size = max(ids.values()) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Whether special strings have other rules than to be found as they are.
        self.odd = any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.normalizer = spec.get("normalizer")
        self.steps = steps = spec.get("pre_tokenizer") or {}
        #: The file's own split pattern, None where it leaves that to the byte-level step.
        self.split: str | None = next((p["pattern"].get("Regex") for p in steps.get("pretokenizers", [steps]) if p.get("type") == "Split"), None)
        symbols = byte_symbols()
        self.base = np.array([ids.get(s, -1) for s in symbols], np.int32)
        self.last = np.array([ids.get(s + self.end, -1) for s in symbols], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        drop = len(self.end)

        def joined(a: str, b: str) -> str:
            return (a[:-drop] if drop and a.endswith(self.end) else a) + b

        self.merges = [(ids[a], ids[b], ids[joined(a, b)]) for a, b in pairs]
        back = {s: b for b, s in enumerate(symbols)}
        self.labels: list[bytes] = [b""] * (max([self.size - 1, *self.special.values()]) + 1)
        for s, i in ids.items():
            s = s[:-drop] if drop and s.endswith(self.end) else s
            self.labels[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.special.items():
            self.labels[i] = s.encode()


class PairTable:
    """(left, right) -> rank, looked up for whole arrays by open addressing. Ids take 16 bits."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        if merges and max(max(m) for m in merges) >= int(PAD):
            raise ValueError("ids beyond 16 bits")
        size = 1 << max(10, (4 * len(merges)).bit_length())
        self.shift = np.uint32(32 - size.bit_length() + 1)
        self.mask = np.uint32(size - 1)
        self.keys = np.full(size, 2**32 - 1, np.uint32)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.array([m[2] for m in merges], np.uint16)
        a = np.array([(m[0] << 16) | m[1] for m in merges], np.uint32)
        for r, (k, h) in enumerate(zip(a.tolist(), self._hash(a).tolist())):
            while self.keys[h] != 2**32 - 1 and self.keys[h] != k:
                h = (h + 1) & int(self.mask)
            if self.keys[h] != k:
                self.keys[h], self.rank[h] = k, r

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1)) >> self.shift

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint32) << np.uint32(16)) | right
        h = self._hash(key)
        got = self.keys[h]
        out = self.rank[h]
        out[got != key] = NONE
        more = np.flatnonzero((got != key) & (got != np.uint32(2**32 - 1)))
        while len(more):
            h[more] = nh = (h[more] + np.uint32(1)) & self.mask
            got = self.keys[nh]
            same = got == key[more]
            out[more[same]] = self.rank[nh[same]]
            more = more[~same & (got != np.uint32(2**32 - 1))]
        return out


class BatchEncoder:
    """BPE of many words at once.

    Words of similar length are the rows of a matrix, padded at the right. In each round every row
    that still has a merge loses one symbol, so the matrix loses a column.
    """

    WIDTHS = (4, 8, 12, 16, 24, 32, 48)

    def __init__(self, vocab: Vocab):
        self.vocab, self.table = vocab, PairTable(vocab.merges)
        if (vocab.base < 0).any() or (vocab.last < 0).any():
            raise ValueError("a byte has no symbol")
        self.symbols = np.concatenate([vocab.base, vocab.last]).astype(np.uint16)
        n = len(self.symbols)
        self.first = self.table.ranks(np.repeat(self.symbols, n), np.tile(self.symbols, n))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in no particular order of the words, and where each word's begin and how many they are."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, at, least = [], 0, 0
        longest = int(size.max(initial=0))
        for most in [*(w for w in self.WIDTHS if w < longest), longest]:
            own = np.flatnonzero((size > least) & (size <= most))
            least = most
            for i in range(0, len(own), 1 << 16):
                some = own[i : i + (1 << 16)]
                ids = self._rows([words[k] for k in some.tolist()], size[some])
                real = ids != PAD
                n = real.sum(1)
                number[some] = n
                start[some] = at + np.cumsum(n) - n
                at += int(n.sum())
                parts.append(ids[real])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16), start, number

    def _rows(self, words: list[bytes], size: np.ndarray) -> np.ndarray:
        """Rows of ids, padded."""
        t, width = self.table, int(size.max())
        real = np.arange(width) < size[:, None]
        sym = np.zeros(real.shape, np.int32)
        sym[real] = np.frombuffer(b"".join(words), np.uint8)
        sym[np.arange(len(words)), size - 1] += 256
        ids = self.symbols[sym]
        ids[~real] = PAD
        if width == 1:
            return ids
        rank = self.first[sym[:, :-1] * len(self.symbols) + sym[:, 1:]]
        rank[~real[:, 1:]] = NONE
        out, own = np.full(real.shape, PAD), np.arange(len(words))
        while True:
            m = ids.shape[1]
            row = np.arange(len(own))
            at = rank.argmin(1)  # the first of the smallest
            low = rank[row, at]
            done = low == NONE
            if done.any():
                out[own[done], :m] = ids[done]
                go = np.flatnonzero(~done)
                if not len(go):
                    return out
                ids, rank, own, at, low, row = ids[go], rank[go], own[go], at[go], low[go], row[: len(go)]
            ids[row, at] = t.merged[low]
            if m == 2:
                out[own, :1] = ids[:, :1]
                return out
            cols = np.arange(m - 1)
            ids = np.where(cols <= at[:, None], ids[:, :-1], ids[:, 1:])
            rank = np.where(cols[:-1] < at[:, None], rank[:, :-1], rank[:, 1:])
            left = np.flatnonzero(at > 0)
            k = at[left]
            rank[left, k - 1] = t.ranks(ids[left, k - 1], ids[left, k])
            right = np.flatnonzero(at < m - 2)
            k = at[right]
            rank[right, k] = t.ranks(ids[right, k], ids[right, k + 1])


class Store:
    """Ids of many entries in one array. Entries beyond `kept` are those of the present batch only."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.start, self.number = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.n = 0
        self.kept = 0, 0

    def keep(self) -> None:
        self.kept = self.n, self.used

    def drop(self) -> None:
        self.n, self.used = self.kept

    def add(self, flat: np.ndarray, start: np.ndarray, number: np.ndarray) -> int:
        """The place of the first of the new entries."""
        first, n, used = self.n, self.n + len(start), self.used + len(flat)
        while n > len(self.start):
            self.start, self.number = np.append(self.start, np.zeros_like(self.start)), np.append(self.number, np.zeros_like(self.number))
        while used > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : used] = flat
        self.start[first:n], self.number[first:n] = start + self.used, number
        self.n, self.used = n, used
        return first


class Lengths:
    """A compact hash table, pre-token -> number of tokens, probed in place for whole arrays.

    Open addressing with linear probing: a slot has the entry's number; entries have their 64-bit
    hash, a 16-bit length, and their place in one block of bytes. Equal hashes count only with equal
    bytes.
    """

    def __init__(self, numbers: dict[bytes, int]):
        words = [w for w, n in numbers.items() if n < 1 << 16]
        self.blob = b"".join(words)
        self.at = np.cumsum([0, *map(len, words)], dtype=np.int32)
        self.number = np.array([numbers[w] for w in words], np.uint16)
        self.hash = self.hashes(words)
        self.slots = np.full(1 << max(4, (2 * len(words)).bit_length()), -1, np.int32)
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hash.tolist()):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = e

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def probe(self, words: pa.Array, as_bytes: list[bytes]) -> np.ndarray:
        """The number of tokens of each word, -1 of those that the table lacks."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.number) or not len(words):
            return out
        keys = pa.Array.from_buffers(pa.binary(), len(self.number), [None, pa.py_buffer(self.at), pa.py_buffer(self.blob)])
        h, mask = self.hashes(as_bytes), np.uint64(len(self.slots) - 1)
        slot, open_ = h & mask, np.arange(len(words))
        while len(open_):
            e = self.slots[slot[open_]]
            open_, e = open_[e >= 0], e[e >= 0]
            same = self.hash[e] == h[open_]
            if same.any():
                own, of = open_[same], e[same]
                equal = pc.equal(keys.take(pa.array(of)), words.take(pa.array(own))).to_numpy(zero_copy_only=False)
                out[own[equal]] = self.number[of[equal]]
                same[np.flatnonzero(same)[~equal]] = False
            open_ = open_[~same]
            slot[open_] = (slot[open_] + np.uint64(1)) & mask
        return out


def _tables() -> tuple[bytes, bytes]:
    """The class and the lower-case form of each character up to U+00FF."""
    kind = bytearray([ODD]) * 256
    lower = bytearray(256)
    for c in range(256):
        s = chr(c)
        if s.isspace() and not 0x1C <= c <= 0x1F:
            kind[c] = SPACE
        elif 0x21 <= c <= 0x7E or c >= 0xA1:
            cat = unicodedata.category(s)
            kind[c] = LETTER if cat[0] == "L" else DIGIT if cat[0] == "N" else MARK
            lower[c] = ord(s.lower())
    return bytes(kind), bytes(lower)


SPACE, LETTER, DIGIT, MARK, ODD = range(5)
KIND, LOW = _tables()
SPACES = np.array([c for c in range(256, 0x110000) if chr(c).isspace()], np.uint32)
#: What follows an apostrophe in the file's split pattern, and the pattern itself.
AFTER_APOSTROPHE = np.frombuffer(b"strvmld", np.uint8)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens:
    """Ids of texts by the lower-casing vocabulary whose words end at white space.

    A text's ids are those of its white-space chunks, one after another, as no token and no rule of
    the file spans white space. The characters of a batch of texts are classed by array operations;
    a chunk of plain ones (Latin-1, which normalisation only lower-cases) falls into pre-tokens, runs
    of one class or single digits, whose distinct values Arrow finds. Those that the worker's store
    lacks are merged in arrays. All other chunks are encoded by the library itself, each once.
    """

    STEP = 1 << 22
    #: Longer entries aren't kept; longer pre-tokens go to the library.
    LONGEST = 64

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab = Vocab(path)
        if self.vocab.split != SPLIT or any(map(str.isspace, "".join(self.vocab.special))):
            raise ValueError("another split pattern, or special strings with white space")
        self.batch = BatchEncoder(self.vocab)
        self.most = most
        self.known: dict[bytes | str, int] = {}  # pre-tokens as bytes of Latin-1, other chunks as strings
        self.store = Store()

    def _begin(self) -> None:
        self.store.drop()
        if len(self.known) > self.most or self.store.used > 16 * self.most:
            self.known, self.store = {}, Store()

    def _learn(self, new: list[bytes | str], merge: bool) -> np.ndarray:
        """Their places in the store. Pre-tokens (merge) are merged here, chunks by the library."""
        short = [w for w in new if len(w) <= self.LONGEST]
        long = [w for w in new if len(w) > self.LONGEST]
        out: dict[bytes | str, int] = {}
        for words, kept in ((short, True), (long, False)):
            if merge and kept:
                got = self.batch.encode([w if w.isascii() else w.decode("latin-1").encode() for w in words])
            else:
                ids = []
                for i in range(0, len(words), 1000):
                    some = [w if isinstance(w, str) else w.decode("latin-1") for w in words[i : i + 1000]]
                    ids += [np.array(e.ids, np.uint16) for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                number = np.array([len(x) for x in ids], np.int64)
                got = np.concatenate(ids) if ids else np.zeros(0, np.uint16), np.cumsum(number) - number, number
            places = range(self.store.n, self.store.n + len(words))
            self.store.add(*got)
            out |= zip(words, places)
            if kept:
                # Entries kept must lie before those dropped; another call may have left some of those.
                if self.store.kept[0] == places.start:
                    self.store.keep()
                    self.known |= zip(words, places)
        return np.array([out[w] for w in new], np.int64)

    def _places(self, words: list[bytes | str], merge: bool, wanted: np.ndarray | None = None) -> np.ndarray:
        get = self.known.get
        out = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        if wanted is not None:
            out[~wanted] = 0
        gaps = np.flatnonzero(out < 0)
        if len(gaps):
            out[gaps] = self._learn([words[i] for i in gaps.tolist()], merge)
        return out

    def _numbers(self, words: list[bytes | str], merge: bool) -> np.ndarray:
        """Their numbers of tokens."""
        places = self._places(words, merge)  # may enlarge the store's arrays
        return self.store.number[places]

    def _parse(self, texts: list[str]):
        """Pre-tokens and odd chunks of texts: Arrow's distinct pre-tokens, the number of each element
        among them, the elements that are odd chunks with these, and the first element of each text."""
        joined = "\n".join(texts) + "\n"
        try:
            raw = joined.encode("latin-1")
        except UnicodeEncodeError:
            wide = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            high = np.flatnonzero(wide > 255)
            narrow = wide.astype(np.uint8)
            narrow[high] = np.where(np.isin(wide[high], SPACES), 32, 0)
            raw = narrow.tobytes()
        kind = np.frombuffer(raw.translate(KIND), np.uint8)
        low = np.frombuffer(raw.translate(LOW), np.uint8)
        odd = [np.flatnonzero(kind == ODD)]
        if b"'" in raw:
            at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 39)
            odd.append(at[np.isin(low[at + 1], AFTER_APOSTROPHE)])
        for s in self.vocab.special:
            at = joined.find(s)
            while at >= 0:
                odd.append(np.array([at]))
                at = joined.find(s, at + 1)
        marked = np.concatenate(odd)
        if len(marked):
            gaps = np.flatnonzero(kind == SPACE)
            at = np.unique(np.searchsorted(gaps, marked))
            begin, end = np.append(0, gaps + 1)[at], gaps[at]
            size = end - begin
            chars = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            kind, low = kind.copy(), low.copy()
            kind[chars], low[chars] = ODD, 0
        solid = kind != SPACE
        new = np.empty(len(kind), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == DIGIT
        at = np.flatnonzero(new & solid)
        data = low[solid]
        off = np.append(np.flatnonzero(new[solid]), len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(data)]).dictionary_encode()
        own = np.flatnonzero(data[off[:-1]] == 0) if len(marked) else np.zeros(0, np.int64)
        begin = at[own]
        chunks = [joined[a:b] for a, b in zip(begin.tolist(), (begin + off[own + 1] - off[own]).tolist())]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return words.dictionary, words.indices.to_numpy(), own, chunks, np.searchsorted(at, first)

    @staticmethod
    def _values(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Arrow's values as bytes, and which of them are pre-tokens (odd chunks are zeros here)."""
        _, off, data = words.buffers()
        off, blob = np.frombuffer(off, np.int32, len(words) + 1, 4 * words.offset), data.to_pybytes() if data else b""
        ends = off.tolist()
        return [blob[a:b] for a, b in zip(ends, ends[1:])], np.frombuffer(blob, np.uint8)[off[:-1]] > 0

    def _batches(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """Texts, or parts of long ones cut at white space, of about STEP characters together."""
        of, some, held = [], [], 0
        for i, t in enumerate(texts):
            at = 0
            while t and at < len(t):
                end = at + self.STEP
                if end < len(t):
                    cut = max(t.rfind(" ", at + 1, end), t.rfind("\n", at + 1, end))
                    end = cut if cut > 0 else len(t)
                part = t if not at and end >= len(t) else t[at:end]
                of.append(i)
                some.append(part)
                held += len(part)
                at += len(part)
                if held >= self.STEP:
                    yield of, some
                    of, some, held = [], [], 0
        if some:
            yield of, some

    def ids(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """For parts of the texts: the text each part is of, ids one after another, and their bounds."""
        for of, some in self._batches(texts):
            self._begin()
            words, index, own, chunks, first = self._parse(some)
            values, plain = self._values(words)
            place = self._places(values, True, plain)[index]
            if len(own):
                place[own] = self._places(chunks, False)
            number, start = self.store.number[place], self.store.start[place]
            end = np.cumsum(number, dtype=np.int64)
            got = self.store.flat[np.repeat(start - end + number, number) + np.arange(end[-1] if len(end) else 0)]
            yield of, got, np.append(0, end)[first]

    def encode(self, texts: list[str | None], kind: str = "<u4") -> list[bytes]:
        """Ids of each text as little-endian numbers of 32 bits, or 16 with "<u2"; null is empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        for of, ids, at in self.ids(texts):
            ids = ids.astype(kind, copy=False)
            for k, i in enumerate(of):
                out[i].append(ids[at[k] : at[k + 1]].tobytes())
        return [b"".join(x) for x in out]

    def pre_tokens(self, text: str | None) -> Counter[bytes]:
        """The plain pre-tokens of a text, and how often each occurs."""
        out: Counter[bytes] = Counter()
        for _, some in self._batches([text]):
            words, index, *_ = self._parse(some)
            values, plain = self._values(words)
            n = np.bincount(index, minlength=len(values))
            out.update({values[i]: int(n[i]) for i in np.flatnonzero(plain).tolist()})
        return out

    def lengths(self, words: list[bytes]) -> dict[bytes, int]:
        """The number of tokens of each pre-token."""
        self._begin()
        return dict(zip(words, self._numbers(words, True).tolist()))

    def count(self, texts: list[str | None], first: Lengths) -> np.ndarray:
        """Numbers of tokens; those of frequent pre-tokens come from `first`."""
        out = np.zeros(len(texts), np.int64)
        for of, some in self._batches(texts):
            self._begin()
            words, index, own, chunks, at = self._parse(some)
            values, plain = self._values(words)
            n = first.probe(words, values)
            rare = np.flatnonzero((n < 0) & plain)
            n[rare] = self._numbers([values[i] for i in rare.tolist()], True)
            number = n[index]
            if len(own):
                number[own] = self._numbers(chunks, False)
            np.add.at(out, of, np.diff(np.append(0, np.cumsum(number))[at]))
        return out


_encoders: dict[tuple[str, int], WordTokens] = {}


def word_tokens(path: str, most: int = 600_000) -> WordTokens:
    """The worker's own encoder, kept over its tasks."""
    if (path, most) not in _encoders:
        _encoders[path, most] = WordTokens(path, most)
    return _encoders[path, most]


def forget() -> None:
    """Free the worker's encoders and their stores, for passes that take no texts."""
    _encoders.clear()
