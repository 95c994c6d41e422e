"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, read_table, release, ship_package

__all__ = [
    "WS", "UPPER", "LOWER", "cut_lineage", "ensure_checkpoint_dir", "read_table", "release", "ship_package",
    "ascii_lower", "parts_for", "strip_ws", "tree_sum", "words_of",
]

# White space and letter classes of the contracts (fixed values)
WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Runs of characters other than ``[\\x20\\x09-\\x0D]``; null gives no words."""
    t = strip_ws(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t\\n\\x0B\\f\\r]+", -1))


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Partitions that hold about ``rows_per_part`` rows each, at least the
    session's shuffle width (so that small inputs still use every core)."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(width, math.ceil(rows / rows_per_part), 1)


#: partial vectors that one task adds up at a time
FAN_IN = 32


def tree_sum(partials: DataFrame, dtype: str, n_parts: int, left: int = 1) -> DataFrame:
    """``bucket`` and ``vector``: the elementwise sums of the vectors of each
    bucket, from rows of ``bucket long, part long, vector binary`` (little-endian
    ``dtype``, equally long in a bucket, ``part`` below ``n_parts``).  The sum
    runs up a tree of groups of at most ``FAN_IN`` vectors, until a bucket has
    at most ``left`` rows."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(rows["vector"].iloc[0], dtype).copy()
        for vector in rows["vector"].iloc[1:]:
            total += np.frombuffer(vector, dtype)
        return pd.DataFrame({"bucket": [key[0]], "part": [key[1]], "vector": [total.tobytes()]})

    while n_parts > left:
        n_parts = math.ceil(n_parts / FAN_IN)
        partials = partials.groupBy("bucket", F.floor(F.col("part") / FAN_IN).cast("long").alias("part")).applyInPandas(
            add, "bucket long, part long, vector binary"
        )
    return partials.select("bucket", "vector")
