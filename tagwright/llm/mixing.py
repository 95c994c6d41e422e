"""Mixing sources to target weights: Pfair scheduling of blocks.

A source's documents, in a fixed pseudo-random order, are cut into blocks of
``block_rows``.  With weight ``w`` its block ``j`` (from 0) is released at slot
``floor(j / w)`` and due at slot ``ceil((j + 1) / w)``; every slot goes to the
released block with the earliest deadline (ties: earlier release, then source).
As the weights sum to one, every deadline is met, so after any number of slots
each source is less than one block away from its target share, as long as it
has blocks.  A source that has run out leaves its slots empty and the others
keep their proportions; no document is dropped or repeated.

Weights are exact integer ratios, never rounded.  The earliest-deadline-first
order is worked out from the block counts alone, a heap entry per source: one
task reads them and streams out one row per block (a 32nd of the rows), to
which the rows are joined.  Blocks that a source does not have take no slot, so
the work does not grow with the empty slots of sources that ran out.

Without given weights the target is ``count ** temperature``, normalised.

Scale: rows are numbered within (source, hash range), so a source that holds a
third of all rows spreads over many tasks; range sizes are prefix-summed.

Edge cases: a null source is a source of its own; rows without an id are
ordered by their reading position; repeated rows are rows like any other;
sources without a given weight raise an error; ``period`` asks for weights
rounded to multiples of ``1 / period``, and then more sources than slots raise
one too; an empty table gives an empty result; columns named like the operator's are
replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage

BLOCK_ROWS = 32
PERIOD = 4_096
TEMPERATURE = 0.5
RANGE_ROWS = 1_000
#: (source, hash range) pairs whose offsets are broadcast; beyond, they are joined
BROADCAST_RANGES = 200_000
#: blocks whose slots are broadcast; beyond, they are joined
BROADCAST_BLOCKS = 200_000
COLUMNS = ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"]


def whole_slots(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots per period of each source: largest remainder, at least one."""
    if not weights:
        return {}
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit into a period of {period} slots")
    if min(weights.values()) <= 0 or not all(map(math.isfinite, weights.values())):
        raise ValueError("weights must be positive and finite")
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    slots = {k: max(1, math.floor(x)) for k, x in exact.items()}
    by_rest = sorted(exact, key=lambda k: (slots[k] - exact[k], k))
    for k in by_rest[: max(0, period - sum(slots.values()))]:
        slots[k] += 1
    while sum(slots.values()) > period:  # many sources below one slot
        k = max((k for k in slots if slots[k] > 1), key=lambda k: (slots[k] - exact[k], k))
        slots[k] -= 1
    return slots


def whole_ratios(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the ratios of the weights."""
    if not all(w > 0 and math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    pairs = {k: w.as_integer_ratio() for k, w in weights.items()}
    scale = math.lcm(*[d for _, d in pairs.values()]) if pairs else 1
    whole = {k: n * (scale // d) for k, (n, d) in pairs.items()}
    common = math.gcd(*whole.values()) or 1
    return {k: n // common for k, n in whole.items()}


def block_slots(ratios: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """``(source, block, slot, release, deadline)`` of all blocks, by earliest
    deadline first; slots in which no block is ready stay empty."""
    total = sum(ratios.values())
    waiting = [(0, k, 0) for k in sorted(ratios) if blocks[k]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // ratios[k]), release, k, j))
        deadline, release, k, j = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        yield k, j, t, release, deadline
        if j + 1 < blocks[k]:
            heapq.heappush(waiting, ((j + 1) * total // ratios[k], k, j + 1))
        t += 1


def schedule(slots: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The blocks of one period of ``sum(slots)`` slots."""
    return list(block_slots(slots, slots))


_SLOTS = "__src string, mix_block long, mix_slot long, mix_release long, mix_deadline long"


def slot_table(spark: SparkSession, ratios: dict[str, int], blocks: dict[str, int]) -> DataFrame:
    """One row per block; written where it is too large to be broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                rows = block_slots(ratios, blocks)
                while part := list(islice(rows, 50_000)):
                    yield pd.DataFrame(part, columns=[f.split()[0] for f in _SLOTS.split(", ")])

    table = spark.range(0, 1, 1, 1).mapInPandas(run, _SLOTS)
    return F.broadcast(table) if sum(blocks.values()) <= BROADCAST_BLOCKS else cut_lineage(table)


def source_key(col: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit("n"))


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    period: int | None = None,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """``docs`` with ``mix_block`` (of its source), ``mix_slot``,
    ``mix_release``, ``mix_deadline`` and ``mix_position`` (order of the mix)."""
    spark = docs.sparkSession
    docs = docs.drop(*COLUMNS)
    keyed = docs.withColumn("__src", source_key(source_col))
    counts = {r["__src"]: r["count"] for r in keyed.groupBy("__src").count().collect()}
    if weights is None:
        target = {k: float(n) ** temperature for k, n in counts.items()}
    else:
        given = {"n" if k is None else f"s{k}": w for k, w in weights.items()}
        if missing := sorted(set(counts) - set(given)):
            raise ValueError(f"no weight for sources {missing[:5]}")
        target = {k: given[k] for k in counts}
    ratios = whole_ratios({k: float(w) for k, w in target.items()}) if period is None else whole_slots(target, period)
    slots = slot_table(spark, ratios, {k: -(-n // block_rows) for k, n in counts.items()})
    # number the rows of a source in hash order
    ranges = max(1, -(-max(counts.values(), default=0) // RANGE_ROWS))
    row = F.monotonically_increasing_id()
    keyed = keyed.withColumn("__row", row)
    keyed = keyed.withColumn("__h", F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.col("__row")))))
    keyed = keyed.withColumn("__range", F.pmod(F.col("__h"), F.lit(ranges)).cast("int"))
    inside = Window.partitionBy("__src", "__range").orderBy("__h", "__row")
    numbered = keyed.withColumn("__n", F.row_number().over(inside) - 1)
    before = Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("__src", "__range")
        .agg(F.count(F.lit(1)).alias("__size"))
        .select("__src", "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__off"))
    )
    if ranges * len(counts) <= BROADCAST_RANGES:
        offsets = F.broadcast(offsets)
    numbered = numbered.join(offsets, ["__src", "__range"]).withColumn("__n", (F.col("__n") + F.col("__off")).cast("long"))
    numbered = (
        numbered.withColumn("mix_block", F.floor(F.col("__n") / block_rows))
        .join(slots, ["__src", "mix_block"])
        .withColumn("mix_position", F.col("mix_slot") * block_rows + F.pmod(F.col("__n"), F.lit(block_rows)))
    )
    return numbered.select(*docs.columns, *COLUMNS)


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows in the order of the mix, in ranges of it."""
    width = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return mixed.repartitionByRange(width, "mix_position").sortWithinPartitions("mix_position")


def mixing_query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source"))
