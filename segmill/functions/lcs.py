"""Longest common subsequences of many strings at once, bit-parallel over arrays.

A short text's places are bits, 64 to a word; a step takes one character of each row's window and
updates all rows' words together: with m the places of that character among the bits s that are
still set, s becomes (s + (s & m)) | (s & ~m), the carry going from word to word. The length is how
often the last word has overflowed. Rows are sorted by length, so those still running are always the first.
Few rows of long texts go the same way one by one over Python's integers, where arrays would be slow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words of rows that are stepped through together.
WORDS = 1 << 14
#: Microseconds of a step of arrays, of that a word and a row's word, and of a step of Python's integers and of that a word.
_CALL, _TAKE, _ROW, _STEP, _WORD = 10.0, 1.0, 0.004, 0.25, 0.02


def word_class(n: int) -> int:
    """Words for n bits, rounded up to a power of two or one and a half of it: so many texts go together."""
    words = max(1, -(-n // 64))
    whole = 1 << (words - 1).bit_length()
    return whole * 3 // 4 if whole > 2 and words <= whole * 3 // 4 else whole


class Masks:
    """The places of each character in short texts of at most so many words.

    Row `first[k] + c` of the table has the places of character c of text k; a character that the
    text lacks has row `first[k]`, which is empty.
    """

    def __init__(self, texts: list[np.ndarray], words: int):
        self.words = words
        known, first = [], [0]
        for t in texts:
            known.append(np.unique(t))
            first.append(first[-1] + len(known[-1]) + 1)
        self.known, self.first = known, first
        self.table = np.zeros((first[-1], self.words), np.uint64)
        for k, t in enumerate(texts):
            places = np.zeros((first[k + 1] - first[k], self.words * 64), bool)
            places[self.codes(k, t) - first[k], np.arange(len(t))] = True
            self.table[first[k] : first[k + 1]] = np.packbits(places, axis=1, bitorder="little").view(np.uint64)

    def backwards(self) -> Masks:
        """The same of the texts read backwards; rows keep their numbers."""
        out = Masks.__new__(Masks)
        out.words, out.known, out.first = self.words, self.known, self.first
        turned = np.zeros_like(self.table)
        for a, b in zip(self.first, self.first[1:]):  # a text at a time: places as bytes take eight times the table's memory
            bits = np.unpackbits(self.table[a:b].view(np.uint8), axis=1, bitorder="little")
            size = int(np.count_nonzero(bits.any(0)))
            bits[:, :size] = bits[:, :size][:, ::-1].copy()
            turned[a:b] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        out.table = turned
        return out

    def codes(self, k: int, chars: np.ndarray) -> np.ndarray:
        """Rows of the table for the characters, as text k has them."""
        own = self.known[k]
        at = np.minimum(np.searchsorted(own, chars), len(own) - 1)
        return np.where(own[at] == chars, at + 1, 0) + self.first[k]


#: Texts of more words go one by one.
MOST_WORDS = 48
_ONE = np.uint64(1)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Each row's flags as the bits of a number."""
    out = np.zeros((len(flags), 8), np.uint8)
    some = np.packbits(flags, axis=1, bitorder="little")
    out[:, : some.shape[1]] = some
    return out.view(np.uint64)[:, 0]


def _by_array(masks: Masks, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, trace: np.ndarray | None) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    words = masks.words
    state = np.full((len(begin), words), _ALL)
    places, total, over = np.empty_like(state), np.empty_like(state), np.empty(state.shape, bool)
    running = len(size) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))
    at, last = begin.copy(), 0
    length = np.zeros(len(begin), np.int64)
    for step, k in enumerate(running.tolist()):
        if k != last:
            s, u, t, c = state[:k], places[:k], total[:k], over[:k]
            at, last = at[:k], k
        np.take(masks.table, codes[at], axis=0, out=u, mode="clip")
        at += 1
        np.bitwise_and(s, u, out=u)
        np.add(s, u, out=t)
        np.less(t, s, out=c)
        # The length grows by one where the last word overflows.
        if words == 1:
            grown = c[:, 0]
        else:
            # Which words overflow, and which are full and pass a carry on, as bits of one number a row:
            # adding the two shows where carries arrive.
            out_of, full = _bits(c), _bits(np.equal(t, _ALL, out=c))
            arrive = ((out_of << _ONE) + full) ^ full
            t += np.unpackbits(arrive.view(np.uint8).reshape(k, 8), axis=1, count=words, bitorder="little")
            grown = (arrive >> np.uint64(words)).astype(bool)
        length[:k] += grown
        if trace is not None:
            trace[step + 1, order[:k]] = length[:k]
        np.bitwise_xor(s, u, out=u)
        np.bitwise_or(t, u, out=s)
    out = np.empty(len(order), np.int64)
    out[order] = length
    return out


def _by_integer(masks: Masks, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, trace: np.ndarray | None) -> np.ndarray:
    used = np.unique(np.concatenate([np.unique(codes[b : b + n]) for b, n in zip(begin.tolist(), size.tolist())]))
    places = {int(c): int.from_bytes(np.ascontiguousarray(masks.table[c]).tobytes(), "little") for c in used}
    top = 64 * masks.words
    full = (1 << top) - 1
    out = []
    for k, (b, n) in enumerate(zip(begin.tolist(), size.tolist())):
        s, lengths = full, [0]
        for c in codes[b : b + n].tolist():
            u = s & places[c]
            t = s + u
            lengths.append(lengths[-1] + (t >> top))
            s = (t | s - u) & full
        out.append(lengths[-1])
        if trace is not None:
            trace[: n + 1, k] = lengths
    return np.array(out, np.int64)


def _batches(masks: Masks, size: np.ndarray) -> Iterator[tuple[np.ndarray, Callable]]:
    """Rows of like length, and the way to step through them."""
    some = np.flatnonzero(size > 0)
    some = some[np.argsort(size[some], kind="stable")]
    rows = max(64, WORDS // masks.words)
    for i in range(0, len(some), rows):
        x = some[i : i + rows]
        n = size[x]
        arrays = int(n.max()) * (_CALL + _TAKE * masks.words) + int(n.sum()) * masks.words * _ROW
        integers = int(n.sum()) * (_STEP + _WORD * masks.words)
        yield x, _by_array if arrays < integers and masks.words <= MOST_WORDS else _by_integer


def lcs_lengths(masks: Masks, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row the LCS length of a text with its window codes[begin : begin + size]."""
    out = np.zeros(len(begin), np.int64)
    for x, way in _batches(masks, size):
        out[x] = way(masks, codes, begin[x], size[x], None)
    return out


def lcs_traces(masks: Masks, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, lengths) in batches: lengths[j, k] is that of the first j characters of the k-th row's window."""
    for x, way in _batches(masks, size):
        trace = np.zeros((int(size[x].max()) + 1, len(x)), np.int32)
        way(masks, codes, begin[x], size[x], trace)
        yield x, trace
