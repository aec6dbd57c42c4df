"""Exact ranges of ids: what a range holds depends on the rows alone, not on how they are stored.

Ids are counted by their upper bits; cells that weigh more than a range are counted again by further
bits, until each is light enough or a single id. Runs of cells make ranges of about `target` each. A
single id (null is one) that weighs more is cut by a hash of the row. A row finds its range by
broadcast joins on its cells; tables of cells have at most about CELLS rows a level or CELLS_A_RANGE
times as many as there are ranges.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 4096
CELLS_A_RANGE = 8


class Ranges(NamedTuple):
    """levels: (shift, {cell: (first part, parts)}) from the coarsest; parts: how many there are in all."""

    levels: list[tuple[int, dict[int, tuple[int, int]]]]
    null: tuple[int, int] | None
    parts: int

    @property
    def cut(self) -> set[int]:
        """The parts that have nothing but rows of one id that is cut."""
        found = [x for _, cells in self.levels for x in cells.values()] + [self.null or (0, 1)]
        return {p for first, n in found if n > 1 for p in range(first, first + n)}

    @property
    def hot(self) -> bool:
        """Whether some id is cut."""
        return bool(self.cut)

    def with_part(self, df: DataFrame, ident: str, digest: Column) -> DataFrame:
        """The rows with a column `part`; rows of an id that is cut are dealt out by the digest, a long."""
        first, number = (F.lit(x) for x in self.null or (0, 1))
        null = F.col(ident).isNull()
        at, cuts = F.when(null, first), F.when(null, number)
        spark = df.sparkSession
        for k, (shift, cells) in enumerate(self.levels):
            known = spark.createDataFrame([(c, *x) for c, x in cells.items()], f"_cell{k} long, _first{k} int, _n{k} int")
            df = df.join(F.broadcast(known), F.shiftright(ident, shift) == known[f"_cell{k}"], "left")
            at, cuts = F.coalesce(at, f"_first{k}"), F.coalesce(cuts, f"_n{k}")
        part = at if not self.hot else at + F.when(cuts > 1, F.pmod(digest, cuts)).otherwise(0)
        return df.withColumn("part", part.cast("int")).drop(*(f"{x}{k}" for k in range(len(self.levels)) for x in ("_cell", "_first", "_n")))


def _weigh(rows: DataFrame, shift: int, among: list[int] | None, above: int) -> dict[int, int]:
    """The weight of each cell; `among` limits them to parts of these cells of the level above."""
    if among is not None:
        spark = rows.sparkSession
        rows = rows.join(F.broadcast(spark.createDataFrame([(c,) for c in among], "_c long")), F.shiftright("id", above) == F.col("_c"), "left_semi")
    got = rows.filter("id IS NOT NULL").groupBy(F.shiftright("id", shift).alias("c")).agg(F.sum("weight").alias("w")).collect()
    return {r["c"]: r["w"] for r in got}


def id_ranges(rows: DataFrame, target: int | None = None, parts: int = 1, least: int = 1, most: int = 1 << 62) -> Ranges:
    """Ranges of rows (id long, weight long) that weigh about `target` each; without a target, the
    weight of all rows divided by `parts`, but within least and most."""
    all_ = rows.agg(F.sum("weight"), F.min("id"), F.max("id"), F.sum(F.when(F.col("id").isNull(), F.col("weight")))).first()
    total, low, high, null = all_[0] or 0, all_[1], all_[2], all_[3] or 0
    target = target or min(max(total // parts, least), most)
    leaves: list[tuple[int, int, int]] = []  # least id, shift, weight
    if low is not None:
        room = max(CELLS, CELLS_A_RANGE * (total // target))
        shift = 0
        while (high >> shift) - (low >> shift) >= room:
            shift += 1
        among, above = None, 0
        while True:
            heavy = []
            for c, w in _weigh(rows, shift, among, above).items():
                if w > target and shift:
                    heavy.append(c)
                else:
                    leaves.append((c << shift, shift, w))
            if not heavy:
                break
            among, above = heavy, shift
            shift = max(0, shift - max(1, (room // len(heavy)).bit_length() - 1))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    part = held = 0
    at_null = None

    def place(w: int, single: bool) -> tuple[int, int]:
        nonlocal part, held
        if held and held + w > target:
            part, held = part + 1, 0
        cuts = -(-w // target) if single and w > target else 1
        got = part, cuts
        held += w
        if cuts > 1 or held >= target:
            part, held = part + cuts, 0
        return got

    if null:
        at_null = place(null, True)
    for first, shift, w in sorted(leaves):
        found.setdefault(shift, {})[first >> shift] = place(w, not shift)
    return Ranges(sorted(found.items(), reverse=True), at_null, max(1, part + bool(held)))
