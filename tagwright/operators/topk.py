"""Exact top-k per group that stays spread out when one group is huge.

Stage 1 ranks inside ``(group, salt)`` where ``salt`` is a hash of a
row-identifying column modulo ``salt_buckets`` and keeps the best ``k`` of
each sub-group; stage 2 ranks the at most ``salt_buckets * k`` survivors of
every group.  The result equals a plain ``row_number() <= k`` because the
global top-k of a group is contained in the union of the top-k of its parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_cols: Sequence[str],
    salt_buckets: int = 64,
    rank_col: str = "rank",
) -> DataFrame:
    """Keep the first ``k`` rows of every group under the total order
    ``order`` and number them 1..k in ``rank_col``.  ``order`` must be a total
    order (end with a unique key) for the result to be deterministic."""
    g = list(group_cols)
    salt = (F.abs(F.xxhash64(*[F.col(c) for c in salt_cols])) % salt_buckets).alias("__salt")
    stage1 = (
        df.withColumn("__salt", salt)
        .withColumn("__r1", F.row_number().over(Window.partitionBy(*g, "__salt").orderBy(*order)))
        .where(F.col("__r1") <= k)
        .drop("__salt", "__r1")
    )
    return stage1.withColumn(rank_col, F.row_number().over(Window.partitionBy(*g).orderBy(*order))).where(
        F.col(rank_col) <= k
    )
