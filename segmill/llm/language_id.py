"""Language identification by a string kernel.

phi(x) marks which n-grams of letters, of 1 to 3 characters, a text has (presence, not counts; all
lengths together, hence a blended spectrum), and K(x, y) = <phi(x), phi(y)> / (|phi(x)| |phi(y)|).
LANDMARKS texts give the Nystroem features; kernel ridge regression, one language against the rest,
is fitted on them. A batch of texts is scored by two matrix products: presence rows with the
landmarks' rows, then kernel values with the coefficients.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS in all, as many of each
language as there are, up to its share; texts of at most SAMPLE_BYTES; the MOST_VALUES most frequent
languages); what is predicted are all rows and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import common
from segmill.session import ship

SAMPLE_ROWS = 2400
LANDMARKS = 192
FEATURES = 8192
RIDGE = 1e-2
#: Texts that models are fitted on have at most so many bytes: 2 x 2,400 x 16 KB reach the driver at most.
SAMPLE_BYTES = 16 << 10
MOST_VALUES = 256
#: Of the symbols, the last BLOCKS are for rarer letters, by their Unicode block.
SYMBOLS, BLOCKS = 128, 30
UND = "und"
LETTER = re.compile("[A-Za-z]")


def held_out(ident: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text, mod 4, is 2. A null id isn't one."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and (LETTER.search(text) is not None or any(map(str.isalpha, text)))


class Spectrum:
    """Presence rows over a fixed list of n-grams. Symbols: 0 for anything but a letter, one each for
    the sample's most frequent letters, and BLOCKS for all others by their place in Unicode."""

    def __init__(self, texts: list[str], features: int):
        letters = Counter(c for t in texts for c in t.lower() if c.isalpha())
        self.letters = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - BLOCKS - 1]]
        self._map()
        df = np.zeros(sum(SYMBOLS**n for n in (1, 2, 3)), np.int64)
        for t in texts:
            df[np.unique(self.grams(t))] += 1
        top = np.argsort(-df, kind="stable")[:features]
        self.of = np.full(len(df), -1, np.int32)
        self.of[top[df[top] > 1]] = np.arange(int((df[top] > 1).sum()))
        self.size = int(self.of.max(initial=-1)) + 1

    def _map(self) -> None:
        self.table = np.zeros(0x110000, np.uint32)
        for block in range(0, 0x110000, 0x1000):
            if 0xD800 <= block < 0xE000:
                continue
            s = "".join(map(chr, range(block, block + 0x1000)))
            self.table[block : block + 0x1000] = [(SYMBOLS - BLOCKS + (ord(c) >> 7) % BLOCKS) * c.isalpha() for c in s]
        for k, c in enumerate(self.letters):
            if len(c) == 1:
                self.table[ord(c)] = k + 1

    def grams(self, text: str) -> np.ndarray:
        a = self.table[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        two = a[:-1] * np.uint32(SYMBOLS) + a[1:]
        three = two[:-1] * np.uint32(SYMBOLS) + a[2:]
        return np.concatenate([a, two + np.uint32(SYMBOLS), three + np.uint32(SYMBOLS + SYMBOLS**2)])

    def rows(self, texts: list[str]) -> np.ndarray:
        """Presence rows of length 1 (or 0, if a text has none of the n-grams)."""
        out = np.zeros((len(texts), self.size + 1), np.float32)
        for row, t in zip(out, texts):
            row[self.of[self.grams(t)]] = 1  # unknown n-grams go to the last place
        out = out[:, :-1]
        norm = np.sqrt(out.sum(1, keepdims=True))
        return out / np.maximum(norm, 1)


class Model:
    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, features: int = FEATURES, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        if len(self.langs) < 2:
            return
        self.spectrum = Spectrum(texts, features)
        x = np.concatenate([self.spectrum.rows(texts[i : i + 256]) for i in range(0, len(texts), 256)])
        y = np.array([self.langs.index(v) for v in langs])
        mine = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        each = max(2, landmarks // len(mine))
        chosen = np.concatenate([m[:each] for m in mine])
        self.marks = np.ascontiguousarray(x[chosen].T)
        k = (x @ self.marks).astype(np.float64)
        w, u = np.linalg.eigh(k[chosen])
        keep = w > 1e-6 * w.max()
        root = u[:, keep] / np.sqrt(w[keep])
        z = np.hstack([k @ root, np.ones((len(k), 1))])
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = (len(y) / (len(mine) * np.maximum(np.bincount(y, minlength=len(mine)), 1)))[y][:, None]
        reg = ridge * np.eye(z.shape[1])
        reg[-1, -1] = 1e-9
        beta = np.linalg.solve(z.T @ (weight * z) + reg, z.T @ (weight * target))
        self.coef = (root @ beta[:-1]).astype(np.float32)
        self.bias = beta[-1].astype(np.float32)
        # How steeply margins become probabilities: the likeliest on the sample.
        margin = z @ beta
        self.steep = min((0.5 * 1.3**i for i in range(16)), key=lambda s: -np.log(self._soft(margin, s)[np.arange(len(y)), y] + 1e-9).mean())

    @staticmethod
    def _soft(margin: np.ndarray, steep: float) -> np.ndarray:
        e = np.exp(steep * (margin - margin.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UND] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        if not some or not self.langs:
            return lang, score
        if len(self.langs) == 1:
            for i in some:
                lang[i], score[i] = self.langs[0], 1.0
            return lang, score
        # In doubles, rounded: how a text is batched changes only what lies beyond.
        k = self.spectrum.rows([texts[i] for i in some]).astype(np.float64) @ self.marks.astype(np.float64)
        p = self._soft(k @ self.coef.astype(np.float64) + self.bias, self.steep).round(9)
        for i, k, s in zip(some, p.argmax(1).tolist(), p.max(1).tolist()):
            lang[i], score[i] = self.langs[k], min(max(s, 0.0), 1.0)
        return lang, score


def fits(text: str = "text"):
    """Rows whose text is short enough to learn from."""
    return F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES


def sampled(rows: DataFrame, by: str, most: int, most_values: int = MOST_VALUES) -> DataFrame:
    """About `most` of the rows (doc_id, by, ...), as evenly by value as there are rows, picked by a hash
    of the id; of a column with more values the `most_values` most frequent ones."""
    sizes = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(most_values).collect()}
    if not sizes:
        return rows.limit(0)
    shares = F.create_map(*[F.lit(x) for v, n in sizes.items() for x in (v, min(1.0, most / (len(sizes) * n)))])
    return rows.filter((F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)) < F.coalesce(shares[F.col(by)], F.lit(0.0)))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_ROWS, most_values: int = MOST_VALUES, **how) -> Model:
    """Learn from the text and the non-null language of rows that aren't held out: of about `sample` rows, and
    of the `most_values` most frequent languages, both of which a table with more may raise."""
    docs = common.pick(df, doc_id=id_col, text=text_col, lang=lang_col).filter(F.col("lang").isNotNull() & ~held_out())
    got = sampled(docs, "lang", sample, most_values).filter(F.col("text").isNotNull() & fits()).select(F.xxhash64("doc_id").alias("h"), "lang", "text").collect()
    got = sorted((r for r in got if has_letter(r["text"])), key=lambda r: (r["h"], r["lang"], r["text"]))[: 2 * sample]
    return Model([r["text"] for r in got], [r["lang"] for r in got], **how)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    A null text and a text without any letter are `und` with score 0. With no labelled row all texts
    are `und`; with one language all that have a letter are that language. Equal texts get equal
    predictions, as scores are rounded to 9 places before the largest is taken, the first of equal ones;
    repeated rows give repeated rows. Texts may be of any length. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model or fit(df, id_col, text_col, lang_col))  # bounded by FEATURES x LANDMARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for ids, out, texts in common.by_bytes(batches, 2, rows=128):
            lang, score = m.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    docs = common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(df: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """The rows that have a learned language with at least this score; all columns, no shuffle."""
    ship(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(model or fit(df, id_col, text_col, lang_col))

    def judge():
        return lambda texts: [lang != UND and s >= least for lang, s in zip(*known.value.predict(texts))]

    return common.keep_rows(df, text_col, judge)
