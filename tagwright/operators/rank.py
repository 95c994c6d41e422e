"""Exact ranks without putting a whole group (or the whole table) into one task.

Two building blocks used by splitting, sampling and per-group caps:

* :func:`blocked_row_number` - ``row_number() over (partition by g order by o)``
  where each group is cut into *blocks* by an order-preserving block key
  (for example ``floor(turn / 4096)`` or a hash prefix).  The window runs per
  ``(group, block)``, block sizes are counted by an aggregation, and a prefix
  sum over the (small) per-block counts gives each block its offset.  A hot
  group therefore spreads over many tasks instead of one.
* :func:`rank_cuts` - find the rows at given global ranks of a hash order by
  counting rows per hash-prefix bucket, then ordering only the few buckets
  that hold a cut.  Membership "rank < r" then becomes a plain comparison
  with the cut row, evaluated map-side with no window and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_row_number(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    block: Column,
    out: str = "rn",
    broadcast_offsets: bool = False,
) -> DataFrame:
    """Add ``out`` = 1-based row number inside each group.

    ``block`` must be non-decreasing in ``order_cols`` within a group; rows are
    ranked inside ``(group, block)`` and shifted by the row count of all
    earlier blocks of the same group.  ``broadcast_offsets`` may be set when
    the number of (group, block) pairs is bounded by construction (e.g. no
    group and a fixed-width hash prefix as block).
    """
    g = list(group_cols)
    df = df.withColumn("__blk", block)
    local = df.withColumn(
        "__lrn", F.row_number().over(Window.partitionBy(*g, "__blk").orderBy(*order_cols))
    )
    counts = df.groupBy(*g, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*g).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*g, "__blk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    if broadcast_offsets:
        offsets = F.broadcast(offsets)
    return (
        local.join(offsets, [*g, "__blk"])
        .withColumn(out, (F.col("__off") + F.col("__lrn")).cast("long"))
        .drop("__blk", "__lrn", "__off")
    )


def bucket_counts(keyed: DataFrame, hash_col: str, prefix_len: int = 4) -> list[tuple[str, int]]:
    """Rows per hash-prefix bucket (at most ``16**prefix_len`` rows reach the
    driver); their sum is the row count."""
    bucket = F.substring(F.col(hash_col), 1, prefix_len)
    return sorted((r["b"], r["n"]) for r in keyed.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())


def rank_cuts(
    keyed: DataFrame,
    hash_col: str,
    id_col: str,
    ranks: Sequence[int],
    prefix_len: int = 4,
    counts: list[tuple[str, int]] | None = None,
) -> dict[int, tuple[str, object] | None]:
    """Return, for every 0-based rank r, the ``(hash, id)`` of the row at rank r
    in the order ``(hash, id)``; ``None`` when r is past the last row.

    ``keyed`` holds one row per id.  Only per-bucket counts (at most
    ``16**prefix_len`` rows) and one row per requested rank reach the driver.
    """
    wanted = sorted({int(r) for r in ranks if r is not None and r >= 0})
    if not wanted:
        return {}
    bucket = F.substring(F.col(hash_col), 1, prefix_len)
    if counts is None:
        counts = bucket_counts(keyed, hash_col, prefix_len)
    # locate the bucket of every wanted rank and its rank inside the bucket
    targets: dict[tuple[str, int], int] = {}
    start = 0
    pos = 0
    for b, n in counts:
        while pos < len(wanted) and wanted[pos] < start + n:
            targets[(b, wanted[pos] - start + 1)] = wanted[pos]
            pos += 1
        start += n
    result: dict[int, tuple[str, object] | None] = {r: None for r in wanted[pos:]}
    if targets:
        # one job: order only the cut buckets (each ~ n / 16**prefix_len rows)
        cut_buckets = sorted({b for b, _ in targets})
        pairs = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b, k in targets])
        rows = (
            keyed.where(bucket.isin(cut_buckets))
            .select(bucket.alias("__b"), hash_col, id_col)
            .withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(hash_col, id_col)))
            .where(F.array_contains(pairs, F.struct(F.col("__b").alias("b"), F.col("__k").cast("int").alias("k"))))
            .collect()
        )
        for row in rows:
            result[targets[(row["__b"], int(row["__k"]))]] = (row[hash_col], row[id_col])
    return result


def before_cut(hash_col: str, id_col: str, cut: tuple[str, object] | None) -> Column:
    """True for rows that come before the cut row in ``(hash, id)`` order."""
    if cut is None:
        return F.lit(True)
    h, i = cut
    return (F.col(hash_col) < F.lit(h)) | ((F.col(hash_col) == F.lit(h)) & (F.col(id_col) < F.lit(i)))
