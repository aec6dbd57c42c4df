"""how well the shorter text fits into some place of the longer, 0 to 100.

The score of two strings is 200 LCS / (length + length), LCS being the longest common subsequence;
the partial score is the best score of the shorter string with any window of the longer one: windows
of its own length, and shorter ones at both ends.

Windows are found by bounds, for all pairs of a batch together. Windows that begin within a block of
places lie within one stretch of the text, and the LCS with that stretch bounds theirs; before that,
counts of shared characters do. Of the blocks that may reach the least score each window gets a bound
of its own from two passes over the stretch, and windows are scored by falling bound until none that is
left can be better.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from segmill import schema
from segmill.functions.lcs import Masks, lcs_lengths, lcs_traces, word_class

#: Characters of long texts, and words of short texts' masks, that are worked on at once.
BATCH_CHARS = 1 << 20
#: Characters of texts that are lower-cased at once.
TEXT_CHARS = 1 << 23


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _best_ratio(most: np.ndarray, n: np.ndarray, least_size: np.ndarray, most_size: np.ndarray) -> np.ndarray:
    """The best score, of 2, of windows with sizes between the two if their LCS is `most` at most."""
    size = np.clip(most, least_size, most_size)
    return 2.0 * np.minimum(most, size) / (n + size)


class _Blocks:
    """Blocks of window starts [x, x + span) of pairs; a window of start x is [max(x, 0), min(x + n, m))."""

    def __init__(self, pair: np.ndarray, x: np.ndarray, last: np.ndarray, n: np.ndarray, m: np.ndarray):
        self.pair, self.x, self.last, self.n, self.m = pair, x, last, n, m  # last: of the block's starts

    def only(self, some: np.ndarray) -> _Blocks:
        return _Blocks(*(v[some] for v in (self.pair, self.x, self.last, self.n, self.m)))

    def stretch(self) -> tuple[np.ndarray, np.ndarray]:
        begin = np.maximum(self.x, 0)
        return begin, np.minimum(self.last + self.n, self.m) - begin

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest size of the windows: sizes rise, stay at n and fall."""
        first, end = (np.minimum(x + self.n, self.m) - np.maximum(x, 0) for x in (self.x, self.last))
        inner = np.minimum(self.n, self.m)
        whole = (self.x <= 0) & (self.last >= 0) | (self.x <= self.m - self.n) & (self.last >= self.m - self.n) | (first == inner)
        return np.minimum(first, end), np.where(whole, inner, np.maximum(first, end))


def _scan(masks: Masks, which: np.ndarray, longs: list[np.ndarray], n: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Best scores, of 1, of pairs of text which[k] (n[k] characters) with longs[k]; 0 where it is below least[k]."""
    m = np.array([len(x) for x in longs], np.int64)
    at = np.cumsum(m) - m
    codes = np.concatenate([masks.codes(k, x) for k, x in zip(which.tolist(), longs)])
    best, hit = least.astype(np.float64).copy(), np.zeros(len(n), bool)

    def lcs_of(blocks: _Blocks) -> np.ndarray:
        begin, size = blocks.stretch()
        return lcs_lengths(masks, codes, at[blocks.pair] + begin, size)

    def may(bound: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return np.where(hit[pair], bound > best[pair], bound >= best[pair])

    # Sizes below `short` can't reach the least score even if all of the window is shared.
    short = np.maximum(np.ceil(least * n / np.maximum(2 - least, 1e-9) - 1e-9).astype(np.int64), 1)
    low, high = short - n, m - short
    # Stretches of one and a half short texts, or all of a long one that isn't much longer.
    span = np.where(5 * m <= 6 * n, np.maximum(high - low + 1, 1), np.maximum(n // 2, 1))
    count = np.maximum(-(-(high - low + 1) // span), 0)
    pair = np.repeat(np.arange(len(n)), count)
    x = low[pair] + (np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)) * span[pair]
    blocks = _Blocks(pair, x, np.minimum(x + span[pair] - 1, high[pair]), n[pair], m[pair])
    shared = _shared(masks, which, codes, at, blocks)
    bound = _best_ratio(shared, blocks.n, *blocks.sizes())
    blocks = blocks.only(may(bound, blocks.pair))
    bound = _best_ratio(lcs_of(blocks), blocks.n, *blocks.sizes())
    blocks = blocks.only(may(bound, blocks.pair))
    if not len(blocks.pair):
        return np.zeros(len(n))
    windows, bound = _windows(masks.backwards(), masks, codes, at, blocks)
    each = 1
    while True:
        left = np.flatnonzero(may(bound, windows.pair))
        if not len(left):
            break
        # Of each pair the windows with the highest bounds, twice as many each time.
        order = left[np.lexsort((-bound[left], windows.pair[left]))]
        new = np.append(True, windows.pair[order][1:] != windows.pair[order][:-1])
        first = np.flatnonzero(new)
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        top = windows.only(order[rank < each])
        got = _best_ratio(lcs_of(top), top.n, *top.sizes())
        good = may(got, top.pair)
        np.maximum.at(best, top.pair[good], got[good])
        hit[top.pair[good]] = True
        rest = order[rank >= each]
        windows, bound, each = windows.only(rest), bound[rest], 2 * each
    return np.where(hit, best, 0.0)


def _windows(back: Masks, masks: Masks, codes: np.ndarray, at: np.ndarray, blocks: _Blocks) -> tuple[_Blocks, np.ndarray]:
    """All windows of the blocks, and a bound on the score of each.

    With f the LCS of the short text and a part of the long one, f is largest on a whole stretch, and what
    its parts lose adds up: f(window) <= f(up to its end) + f(from its start) - f(stretch). One pass gives
    the second for all ends, one from the back the third for all starts.
    """
    begin, size = blocks.stretch()
    ends = np.empty(len(size), object)
    for rows, trace in lcs_traces(masks, codes, at[blocks.pair] + begin, size):
        for k, r in enumerate(rows.tolist()):
            ends[r] = trace[: size[r] + 1, k].copy()
    starts = np.empty(len(size), object)
    total = len(codes)
    for rows, trace in lcs_traces(back, codes[::-1], total - (at[blocks.pair] + begin + size), size):
        for k, r in enumerate(rows.tolist()):
            starts[r] = trace[: size[r] + 1, k].copy()
    count = blocks.last - blocks.x + 1
    block = np.repeat(np.arange(len(size)), count)
    x = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count) + blocks.x[block]
    windows = _Blocks(blocks.pair[block], x, x, blocks.n[block], blocks.m[block])
    most = np.empty(len(block), np.int64)
    low, own = windows.stretch()
    low = low - begin[block]
    i = 0
    for r, c in enumerate(count.tolist()):
        a, e = low[i : i + c], low[i : i + c] + own[i : i + c]
        most[i : i + c] = ends[r][e] + starts[r][size[r] - a] - ends[r][size[r]]
        i += c
    return windows, _best_ratio(most, windows.n, *windows.sizes())


def _shared(masks: Masks, which: np.ndarray, codes: np.ndarray, at: np.ndarray, blocks: _Blocks) -> np.ndarray:
    """How many characters, counted with repeats, a block's stretch shares with its text."""
    begin, size = blocks.stretch()
    begin = begin + at[blocks.pair]
    held = np.bitwise_count(masks.table).sum(1, dtype=np.int64)  # how often its text has the character of a row
    out = np.zeros(len(size), np.int64)
    width = np.diff(masks.first)[which[blocks.pair]]
    low = np.array(masks.first)[which[blocks.pair]]
    i = 0
    while i < len(size):
        j = i + max(1, int(np.searchsorted(np.cumsum(size[i:] + width[i:]), BATCH_CHARS)))
        base = np.cumsum(width[i:j]) - width[i:j]
        place = np.repeat(begin[i:j] - np.cumsum(size[i:j]) + size[i:j], size[i:j]) + np.arange(size[i:j].sum())
        counts = np.bincount(np.repeat(base - low[i:j], size[i:j]) + codes[place], minlength=int(width[i:j].sum()))
        rows = np.repeat(low[i:j] - base, width[i:j]) + np.arange(len(counts))
        out[i:j] = np.add.reduceat(np.minimum(counts, held[rows]), base)
        i = j
    return out


def partial_ratios(a: list[str], b: list[str], least: float | np.ndarray = 0.0) -> np.ndarray:
    """The score of each pair; where it is below `least`, 0."""
    bound = np.broadcast_to(np.asarray(least, np.float64), (len(a),))
    out = np.zeros(len(a), np.float64)
    by_words: dict[int, list[tuple[int, str, str]]] = defaultdict(list)
    for k, (x, y) in enumerate(zip(a, b)):
        if len(x) > len(y):
            x, y = y, x
        if not x:
            out[k] = 0.0 if y else 100.0
        elif x in y:
            out[k] = 100.0
        else:
            by_words[word_class(len(x))].append((k, x, y))
    for words, rows in by_words.items():
        i = 0
        while i < len(rows):
            j, held, known = i, 0, set()
            while j < len(rows):
                _, x, y = rows[j]
                held += len(y) + (0 if x in known else (len(set(x)) + 1) * words)
                if held > BATCH_CHARS and j > i:
                    break
                known.add(x)
                j += 1
            some, i = rows[i:j], j
            names = {x: n for n, x in enumerate(dict.fromkeys(x for _, x, _ in some))}
            texts = {y: _chars(y) for y in dict.fromkeys(y for _, _, y in some)}
            masks = Masks([_chars(x) for x in names], words)
            ks = np.array([k for k, _, _ in some])
            n = np.array([len(x) for _, x, _ in some], np.int64)
            out[ks] = 100.0 * _scan(masks, np.array([names[x] for _, x, _ in some]), [texts[y] for _, _, y in some], n, bound[ks] / 100.0)
    return out


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The score of one pair."""
    return float(partial_ratios([a], [b], least)[0])


def windowed_score(short: str, long: str, least: float = schema.MATCH_SCORE) -> float:
    """Texts up to WHOLE_CHARS are compared whole; of longer ones the windows in turn, and the first
    that reaches `least` settles the score."""
    short, long = short.lower(), long.lower()
    if not short or not long:
        return 0.0
    if len(long) <= schema.WHOLE_CHARS:
        return partial_ratio(short, long)
    best = 0.0
    for i in range(0, len(long), schema.WINDOW_STEP):
        best = max(best, partial_ratio(short, long[i : i + schema.WINDOW_CHARS], best))
        if best >= least:
            break
    return best


def _scores(a: pd.Series, b: pd.Series, least: float | np.ndarray) -> pd.Series:
    """Of each row; null and empty texts score 0."""
    out = np.zeros(len(a))
    bound = np.broadcast_to(np.asarray(least, np.float64), (len(a),))
    rows, chars = [], 0
    for k, (x, y) in enumerate(zip(a, b)):
        if x and y:
            rows.append(k)
            chars += len(x) + len(y)
        if rows and (chars >= TEXT_CHARS or k == len(a) - 1):  # lower-case copies of so many characters at once
            out[rows] = partial_ratios([a.iat[k].lower() for k in rows], [b.iat[k].lower() for k in rows], bound[rows])
            rows, chars = [], 0
    return pd.Series(out)


def partial_ratio_udf(least: float = 0.0):
    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return _scores(a, b, least)

    return score


def partial_ratio_from_udf():
    """Like partial_ratio_udf with the least score of each row."""

    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
        return _scores(a, b, least.fillna(0.0).to_numpy())

    return score


def pair_score(a: Column, b: Column, least: float = 0.0) -> Column:
    return partial_ratio_udf(least)(a, b)
