"""Exact percentiles without gathering a column's values in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: equal parts into which an interval is cut in a round
PARTS = 1024
#: rows of an interval that are sorted once it is that small
FEW = 4096


def exact_percentiles(df: DataFrame, wanted: Sequence[tuple[str, float]], parts: int = PARTS, few: int = FEW) -> list[float | None]:
    """The linear percentile (share in 0..1) of each wanted column, nulls and
    NaN left out; None where a column has no value.

    Each needed rank is searched in rounds: rows inside its interval are
    counted over ``parts`` equal parts (partial aggregation, so at most
    ``parts`` counts a task and rank move), and the part holding the rank is
    the next interval, until it holds one value or at most ``few`` rows, which
    are then sorted.  All ranks advance together, one job a round.
    """
    cols = sorted({c for c, _ in wanted})
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    base = df.agg(*[f(value[c]).alias(f"{k}_{i}") for i, c in enumerate(cols) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    size = {c: base[f"n_{i}"] for i, c in enumerate(cols)}
    bounds = {c: (base[f"lo_{i}"], base[f"hi_{i}"]) for i, c in enumerate(cols)}
    ranks: dict[tuple[str, int], tuple[float, float, int, int]] = {}  # interval, rows below it, rows in it
    for c, share in wanted:
        for r in {math.floor((size[c] - 1) * share), math.ceil((size[c] - 1) * share)} if size[c] else ():
            ranks[c, r] = (*bounds[c], 0, size[c])
    found: dict[tuple[str, int], float] = {}

    def inside(c: str, lo: float, hi: float) -> Column:
        return value[c].between(lo, hi)

    while True:
        for key in [k for k in ranks if ranks[k][0] == ranks[k][1]]:
            found[key] = ranks.pop(key)[0]
        small = {k for k, (*_, n) in ranks.items() if n <= few}
        if small:
            rows = df.select(F.explode(F.array(*[
                F.when(inside(c, *ranks[c, r][:2]), F.struct(F.lit(i).alias("i"), value[c].alias("v"))) for i, (c, r) in enumerate(sorted(small))
            ])).alias("x")).where("x is not null").select("x.*").groupBy("i", "v").agg(F.count("*").alias("n")).collect()
            for i, key in enumerate(sorted(small)):
                left = key[1] - ranks.pop(key)[2]
                for v, n in sorted((row["v"], row["n"]) for row in rows if row["i"] == i):
                    if left < n:
                        found[key] = v
                        break
                    left -= n
        if not ranks:
            break
        order = sorted(ranks)
        tests = []
        for i, (c, r) in enumerate(order):
            lo, hi = ranks[c, r][:2]
            part = F.least(F.floor((value[c] / 2 - lo / 2) / ((hi / 2 - lo / 2) / parts)), F.lit(parts - 1)).cast("int")
            tests.append(F.when(inside(c, lo, hi), F.struct(F.lit(i).alias("i"), part.alias("part"), value[c].alias("v"))))
        counts = df.select(F.explode(F.array(*tests)).alias("x")).where("x is not null").select("x.*")
        rows = counts.groupBy("i", "part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for i, key in enumerate(order):
            below = ranks[key][2]
            for row in sorted((x for x in rows if x["i"] == i), key=lambda x: x["part"]):
                if key[1] < below + row["n"]:
                    ranks[key] = (row["lo"], row["hi"], below, row["n"])
                    break
                below += row["n"]

    out: list[float | None] = []
    for c, share in wanted:
        if not size[c]:
            out.append(None)
            continue
        at = (size[c] - 1) * share
        a, b = found[c, math.floor(at)], found[c, math.ceil(at)]
        out.append(a if a == b else a + (b - a) * (at - math.floor(at)))
    return out


def grouped_medians(df: DataFrame, group_col: str, cols: Sequence[str]) -> DataFrame:
    """``group_col`` and the exact median of each column (``cols`` names kept).
    Rows are first counted per group and value, so a group's sort holds its
    different values, not its rows (texts' lengths are few)."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    counts = df.select(group_col, F.explode(pairs).alias("x")).select(group_col, "x.*").where("v is not null")
    counts = counts.groupBy(group_col, "i", "v").agg(F.count("*").alias("n"))
    own = Window.partitionBy(group_col, "i")
    upto = F.sum("n").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = counts.withColumns({"upto": upto, "total": F.sum("n").over(own)})
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
    ends = c.groupBy(group_col, "i").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    return ends.groupBy(group_col).agg(*[F.max(F.when(F.col("i") == i, (F.col("a") + F.col("b")) / 2)).alias(name) for i, name in enumerate(cols)])
