"""Reproducible splits and exact-size samples.

The reference shuffles with a seeded permutation and cuts at exact sizes.  A
permutation needs all rows in one place, so here the order is the hash
``md5("<seed>:<id>")`` (tie-break on the id), which is the same in Spark and
DuckDB.  Sizes follow the library rule "test side = ceil(n * frac), the rest
is train".  Members differ from the reference run; sizes do not.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as D
from ..session import cut_lineage
from .rank import bucket_counts, rank_cuts

SPLITS = ("train", "validation", "test", "new_data")
#: hex digits of the hash by which :func:`group_cuts` counts
CUT_PREFIX = 4
#: above this many bytes the table of cuts is joined by shuffle, not broadcast
CUTS_LIMIT_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class SplitFractions:
    discovery: float = D.DISCOVERY_FRACTION
    train: float = D.TRAIN_FRACTION
    validation: float = D.VALIDATION_FRACTION
    test: float = D.TEST_FRACTION

    def validate(self) -> None:
        """Argument checks, raised before any job runs."""
        if not 0.0 < self.discovery < 1.0:
            raise ValueError("discovery fraction must be between 0 and 1")
        total = self.train + self.validation + self.test
        if abs(total - 1.0) > 1e-9:
            raise ValueError(f"train, validation and test fractions must sum to 1.0 (got {total:.6f})")
        for name in ("train", "validation", "test"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} fraction must be greater than 0")

    def sizes(self, n: int) -> dict[str, int]:
        """Exact split sizes for n items (nested: discovery/new, then 70/15/15)."""
        n_new = math.ceil((1.0 - self.discovery) * n)
        n_disc = n - n_new
        vt = self.validation + self.test
        n_vt = math.ceil(vt * n_disc)
        n_train = n_disc - n_vt
        n_test = math.ceil((self.test / vt) * n_vt)
        return {"train": n_train, "validation": n_vt - n_test, "test": n_test, "new_data": n_new}


def hash_key(id_col: str | Column, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def split_assignment(
    df: DataFrame, id_col: str, seed: int = D.SEED, fractions: SplitFractions = SplitFractions()
) -> tuple[Column, dict[str, int]]:
    """A column expression giving ``source_split`` for every row of any
    frame that carries ``id_col``, plus the split sizes.

    Work: one aggregation (distinct ids counted per 4-hex hash bucket; the
    counts also give n) and one ordered pass over the (at most three) buckets
    holding a cut.  The
    returned expression is then evaluated map-side - no window over the data
    and no join back.
    """
    fractions.validate()
    ids = df.select(id_col).distinct().withColumn("__h", hash_key(id_col, seed))
    counts = bucket_counts(ids, "__h")
    n = sum(c for _, c in counts)
    sizes = fractions.sizes(n)
    b1 = sizes["train"]
    b2 = b1 + sizes["validation"]
    b3 = b2 + sizes["test"]
    cuts = rank_cuts(ids, "__h", id_col, [b1, b2, b3], counts=counts)
    h = hash_key(id_col, seed)

    def lt(rank: int) -> Column:
        cut = cuts.get(rank)
        if cut is None:
            return F.lit(True)
        ch, ci = cut
        return (h < F.lit(ch)) | ((h == F.lit(ch)) & (F.col(id_col) < F.lit(ci)))

    expr = (
        F.when(lt(b1), "train").when(lt(b2), "validation").when(lt(b3), "test").otherwise("new_data")
    )
    return expr, sizes


def split_counts(df: DataFrame, split_col: str = "source_split") -> DataFrame:
    """Rows per split and the effective fraction of the total."""
    c = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
    # window over the aggregated rows only (one row per split)
    total = F.sum("rows").over(Window.partitionBy())
    return c.withColumn("fraction", F.round(F.col("rows") / total, 6))


def exact_sample(df: DataFrame, id_col: str, size: int | None, seed: int = D.SEED) -> DataFrame:
    """Exactly ``size`` rows (the first in hash order), rows kept in place;
    no-op when ``size`` is None or not below the row count.  ``id_col`` must be
    unique."""
    if size is None:
        return df
    keyed = df.select(id_col).withColumn("__h", hash_key(id_col, seed))
    cut = rank_cuts(keyed, "__h", id_col, [size]).get(size)
    if cut is None:
        return df
    return df.where(before_cut_expr(id_col, seed, cut))


def before_cut_expr(id_col: str, seed: int, cut) -> Column:
    h = hash_key(id_col, seed)
    ch, ci = cut
    return (h < F.lit(ch)) | ((h == F.lit(ch)) & (F.col(id_col) < F.lit(ci)))


def group_cuts(df: DataFrame, group_cols: list[str], key_col: str, cap: int, seed: int = D.SEED) -> DataFrame:
    """Where the hash order of each group of at least ``cap`` rows reaches row
    ``cap``: the group, the hash prefix of that row (``__cut``) and how many
    rows of this prefix still belong (``__left``).

    Only counts per (group, prefix) move, added up before the shuffle, so a
    group has at most ``16**CUT_PREFIX`` of them however many rows it holds.
    """
    prefix = F.substring(hash_key(key_col, seed), 1, CUT_PREFIX)
    counts = df.groupBy(*group_cols, prefix.alias("__cut")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*group_cols).orderBy("__cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("__n").over(upto) - F.col("__n")
    counts = counts.withColumn("__before", before).where((F.col("__before") < cap) & (F.col("__before") + F.col("__n") >= cap))
    return counts.select(*group_cols, "__cut", (F.lit(cap) - F.col("__before")).alias("__left"))


def cap_per_group(
    df: DataFrame, group_cols: list[str], key_col: str, cap: int | None, seed: int = D.SEED
) -> DataFrame:
    """At most ``cap`` rows per group, chosen by hash order of ``key_col``
    (null values of the group columns form groups like any other; rows with
    equal keys are ordered arbitrarily among themselves).

    :func:`group_cuts` finds each group's cut first; rows past it go where
    they are read, and only the rows up to it, about ``cap`` a group, are
    shuffled, to be ranked inside (group, prefix).  The table of cuts is
    broadcast if its measured size is at most ``CUTS_LIMIT_BYTES``.
    """
    if cap is None:
        return df
    if cap <= 0:
        return df.where(F.lit(False))
    cuts = cut_lineage(group_cuts(df, group_cols, key_col, cap, seed))
    size = cuts.agg(F.sum(F.length(F.to_json(F.struct(*group_cols))) + 64)).first()[0] or 0
    names = {c: f"__g{i}" for i, c in enumerate(group_cols)}
    cuts = cuts.withColumnsRenamed(names)
    if size <= CUTS_LIMIT_BYTES:
        cuts = F.broadcast(cuts)
    keyed = df.withColumn("__h", hash_key(key_col, seed)).withColumn("__p", F.substring("__h", 1, CUT_PREFIX))
    same = [F.col(c).eqNullSafe(F.col(g)) for c, g in names.items()]
    near = keyed.join(cuts, same, "left").where(F.col("__cut").isNull() | (F.col("__p") <= F.col("__cut")))
    rank = F.row_number().over(Window.partitionBy(*group_cols, "__p").orderBy("__h", key_col))
    kept = F.col("__cut").isNull() | (F.col("__p") < F.col("__cut")) | (F.col("__rn") <= F.col("__left"))
    return near.withColumn("__rn", rank).where(kept).select(*df.columns)


__all__ = [
    "SPLITS",
    "SplitFractions",
    "cap_per_group",
    "exact_sample",
    "group_cuts",
    "hash_key",
    "split_assignment",
    "split_counts",
]
