import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Nulls in each column, empty and blank texts, ties, repeated rows; (doc_id, text).
ROWS = [
    (5, "one two three four five six"), (3, "one two three four five six"), (9, None), (7, ""), (None, "lost id"), (2, " one\ttwo  three "), (1, " one two three "),
    (4, "Ärger über Öl <|endoftext|> x"), (4, "Ärger über Öl <|endoftext|> x"), (11, "\n"), (12, " "), (6, "the quick brown fox " * 4000), (8, "x" * 5000), (10, "\u00e9\u0301 \U0001f600 12 don't"),
]


def docs(spark, rows=ROWS):
    """Documents with extra columns whose names clash with the operators' own."""
    cols = "doc_id long, text string, keep_id string, gid int, part string, node string, fp string, kept string, score string"
    return spark.createDataFrame([(*r, "a", 1, "b", "c", "d", "e", "f") for r in rows], cols)


def empty(spark):
    return docs(spark, [])
