"""Neighbour passes over pivot cells against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.operators import cells as C
from tagwright.operators.density import core_distances, knn_graph, mutual_reachability_mst


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def lumps():
    """Six far lumps, one of them with a third of all points, 40 equal points and two zero vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 40
    part = [centres[i] + rng.normal(size=(n, 4)) for i, n in enumerate([130, 50, 50, 50, 40, 38])]
    same = np.repeat(centres[:1] + 0.5, 40, axis=0)
    return np.vstack([*part, same, np.zeros((2, 4))])


def _brute(x, k, metric):
    d = np.round(C.distances(x, x, metric), 12)
    out = {}
    for i, row in enumerate(d):
        order = sorted((v, j) for j, v in enumerate(row) if j != i)
        out[i] = [j for _, j in order[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_graph_equals_brute_force_over_many_cells(spark, lumps, metric):
    rows = knn_graph(_frame(spark, lumps), "id", "vec", k=7, metric=metric, block_size=16).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["nbr"])
    assert got == _brute(lumps, 7, metric)


def test_bounds_hold_and_far_cells_are_passed_over(spark, lumps):
    pts, cells = C.make_cells(_frame(spark, lumps), "id", "vec", block_size=16)
    rows = pts.collect()
    assert len(rows) == len(lumps) and cells.size.sum() == len(lumps)
    assert max(np.bincount([r["cell"] * 1000 + r["block"] for r in rows])) <= 48
    to_pivot = cells.to_pivots(lumps)
    least, most = cells.least(to_pivot), cells.most(to_pivot, lumps)
    d = C.distances(lumps, lumps)
    for r in rows:
        assert (least[:, r["cell"]] <= d[:, r["id"]]).all() and (d[:, r["id"]] <= most[:, r["cell"]]).all()

    def near(b, to_pivot):
        return cells.least(to_pivot) <= 5.0

    sent = C.visitors(pts, cells, near, ["id"], "id long")
    assert 0 < sent.count() < 0.5 * len(lumps) * cells.blocks.sum()


def test_core_distances_and_spanning_tree_over_many_cells(spark, lumps):
    x = lumps[::2]
    df = _frame(spark, x)
    d = C.distances(x, x)
    core = np.sort(d, axis=1)[:, 4]
    got = {r["id"]: r["core"] for r in core_distances(df, "id", "vec", 5, block_size=16).collect()}
    assert np.allclose([got[i] for i in range(len(x))], core, atol=1e-12)
    w = np.maximum(d, np.maximum.outer(core, core))
    pairs = sorted((w[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = set()
    for _, i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            tree.add((i, j))
    edges = mutual_reachability_mst(df, "id", "vec", 5, block_size=16)[1].collect()
    assert {(r["a"], r["b"]) for r in edges} == tree


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (None, [1.0, 1.0]), (3, [float("nan"), 0.0]), (4, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").withColumn("cell", F.lit("x"))
    got = knn_graph(df, "id", "vec", k=3, block_size=1).collect()
    assert sorted((r["id"], r["nbr"], r["dist"]) for r in got) == [(1, 4, 1.0), (4, 1, 1.0)]
    none = df.where("false")
    assert knn_graph(none, "id", "vec", k=3).count() == 0
    assert mutual_reachability_mst(none, "id", "vec", 3)[1].count() == 0
