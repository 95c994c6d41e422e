"""Exact ranks, splits and samples, including a group holding a third of the
rows (the skew case every ranking must survive)."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagwright.operators.rank import blocked_row_number, rank_cuts
from tagwright.operators import split
from tagwright.operators.split import SplitFractions, cap_per_group, exact_sample, split_assignment
from tagwright.operators.topk import top_k_per_group


def _skewed(spark, n=3000):
    # group 0 holds a third of all rows
    rows = [(0 if i % 3 == 0 else i % 17 + 1, i, (i * 7919) % 1000) for i in range(n)]
    return spark.createDataFrame(rows, "g int, id long, turn long")


def test_blocked_row_number_equals_window(spark):
    df = _skewed(spark)
    got = blocked_row_number(df, ["g"], ["turn", "id"], F.floor(F.col("turn") / 64), out="rn")
    want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("turn", "id")))
    j = got.join(want, ["g", "id"])
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0
    assert j.count() == df.count()


def test_top_k_per_group_equals_window(spark):
    df = _skewed(spark)
    got = top_k_per_group(df, ["g"], [F.desc("turn"), F.asc("id")], 7, salt_cols=["id"], salt_buckets=8)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("turn"), F.asc("id")))).where("r <= 7")
    assert sorted(map(tuple, got.select("g", "id", "rank").collect())) == sorted(map(tuple, want.select("g", "id", "r").collect()))


def test_split_sizes_and_membership(spark):
    n = 1001
    df = spark.createDataFrame([(i,) for i in range(n)], "conv_id long")
    expr, sizes = split_assignment(df, "conv_id", seed=393)
    assert sum(sizes.values()) == n
    assert sizes["new_data"] == math.ceil(0.75 * n)
    got = dict(df.select(expr.alias("s")).groupBy("s").count().collect())
    assert got == {k: v for k, v in sizes.items() if v}
    # brute force: order by md5, cut at the sizes
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"393:{i}".encode()).hexdigest(), i))
    want = {}
    pos = 0
    for name in ("train", "validation", "test", "new_data"):
        for i in order[pos : pos + sizes[name]]:
            want[i] = name
        pos += sizes[name]
    rows = dict(df.select("conv_id", expr.alias("s")).collect())
    assert rows == want


def test_fraction_checks():
    import pytest

    with pytest.raises(ValueError):
        SplitFractions(discovery=1.0).validate()
    with pytest.raises(ValueError):
        SplitFractions(train=0.7, validation=0.2, test=0.2).validate()
    with pytest.raises(ValueError):
        SplitFractions(train=1.0, validation=0.0, test=0.0).validate()


def test_exact_sample_and_cap(spark):
    df = _skewed(spark)
    s = exact_sample(df, "id", 100)
    assert s.count() == 100
    assert exact_sample(df, "id", 10**6).count() == df.count()
    capped = cap_per_group(df, ["g"], "id", 5)
    per = dict(capped.groupBy("g").count().collect())
    assert set(per.values()) == {5}


def test_cap_matches_a_full_sort(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}" if i % 2 else None, "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, g string, pair string").repartition(6)

    def order(i):
        return hashlib.md5(f"42:{i}".encode()).hexdigest(), i

    groups = {}
    for i, g, _ in rows:
        groups.setdefault(g, []).append(i)
    for limit in (split.CUTS_LIMIT_BYTES, -1):  # cuts broadcast, cuts joined by shuffle
        monkeypatch.setattr(split, "CUTS_LIMIT_BYTES", limit)
        for cap in (1, 7, 150, 10_000):
            got = cap_per_group(df, ["g"], "id", cap, seed=42)
            assert got.columns == df.columns
            expected = {(i, g, "x") for g, ids in groups.items() for i in sorted(ids, key=order)[:cap]}
            found = [tuple(r) for r in got.collect()]
            assert len(found) == len(expected) and set(found) == expected
    assert cap_per_group(df, ["g"], "id", 0).count() == 0
    assert cap_per_group(df, ["g"], "id", None) is df
    assert cap_per_group(df.limit(0), ["g"], "id", 3).count() == 0
    repeated = spark.createDataFrame([(1, "a")] * 9, "id long, g string")
    assert cap_per_group(repeated, ["g"], "id", 4).count() == 4


def test_rank_cuts_past_end(spark):
    df = spark.createDataFrame([(i, hashlib.md5(str(i).encode()).hexdigest()) for i in range(50)], "id long, h string")
    cuts = rank_cuts(df, "h", "id", [0, 49, 50])
    assert cuts[50] is None
    first = min((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(50))
    assert cuts[0] == first
