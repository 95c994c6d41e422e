"""Findings of round 4."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tagwright.operators import cells as C
from tagwright.operators import density as D
from tagwright.operators import spanning as S
from tagwright.operators.density import hdbscan, knn_graph, mutual_reachability_mst


def _frame(spark, x, ids=None, kind="double"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], f"id long, vec array<{kind}>")


def _lumps(seed=1):
    """Lumps, a grid with many equal distances, copies, and two far points."""
    rng = np.random.default_rng(seed)
    lumps = [rng.normal(size=(40, 2)) * s + c for s, c in ((1, [0, 0]), (2, [30, 0]), (0.3, [0, 50]))]
    grid = rng.integers(0, 4, size=(50, 2)).astype(float) + [0.0, 100.0]
    x = np.vstack([*lumps, grid, np.repeat([[7.0, 7.0]], 20, axis=0), [[500.0, 0.0], [0.0, 900.0]]])
    return x, rng.permutation(len(x)) - (1 << 62)  # ids that no double holds


def test_one_task_gives_the_clusters_of_the_joins(spark):
    """the rounds in one task do the whole work of those by joins, in far fewer jobs."""
    x, ids = _lumps()
    df = _frame(spark, x, ids)
    sc = spark.sparkContext
    sc.setJobGroup("one task", "")
    labels, facts = hdbscan(df, "id", "vec", min_cluster_size=8, min_samples=4, block_size=32)
    got = {r["id"]: r["cluster"] for r in labels.collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("one task"))
    sc.setJobGroup("joins", "")
    labels, more = hdbscan(df, "id", "vec", min_cluster_size=8, min_samples=4, block_size=32, block_edges=150)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {r["id"]: r["cluster"] for r in labels.collect()} and len(got) == len(x)
    assert facts == more and facts["cluster_count"] >= 4 and 0 < facts["noise_count"] < 40
    assert jobs < 250


def test_both_ways_give_the_spanning_tree(spark):
    x, ids = _lumps(2)
    trees = [mutual_reachability_mst(_frame(spark, x, ids), "id", "vec", 4, block_size=32, one_task=n)[1] for n in (1 << 20, 30)]
    one, two = ({tuple(r) for r in t.collect()} for t in trees)
    assert one == two and len(one) == len(x) - 1


def test_rounds_in_one_task():
    """Weights tie, ids need all 64 bits, a searched component takes its edge whatever its radius."""
    ids = np.arange(6) + (1 << 62)
    points = pd.DataFrame({"id": ids, "comp": ids, "radius": [2.0, 2.0, 2.0, 2.0, 0.5, 2.0]})
    edges = pd.DataFrame({"a": ids[[0, 1, 0, 3, 3]], "b": ids[[1, 2, 2, 4, 4]], "w": [1.0, 1.0, 1.0, 1.0, 1.0], "of": 0, "searched": False})
    rows = S.joined(points, edges)
    kind = lambda rows, k: rows[rows["kind"] == k]
    assert {(a, b) for a, b in kind(rows, S.TREE)[["a", "b"]].values} == {(ids[0], ids[1]), (ids[0], ids[2]), (ids[3], ids[4])}
    comps = kind(rows, S.COMPONENT)
    assert dict(zip(comps["comp"], comps["n"])) == {ids[0]: 3, ids[3]: 2, ids[5]: 1}
    places = kind(rows, S.POINT)[["a", "comp", "w"]].set_axis(["id", "comp", "radius"], axis=1).astype({"id": "int64", "comp": "int64"})
    more = pd.DataFrame({"a": ids[[2, 3]], "b": ids[[3, 5]], "w": [7.0, 9.0], "of": ids[[3, 5]], "searched": True})
    rows = S.joined(places, more)
    assert len(kind(rows, S.TREE)) == 2 and list(kind(rows, S.COMPONENT)["n"]) == [6]
    assert kind(rows, S.POINT).sort_values("a")["w"].tolist() == [2.0, 2.0, 2.0, 7.0, 7.0, 9.0]


def test_forest_keeps_the_lightest_ways_out():
    rng = np.random.default_rng(5)
    edges = pd.DataFrame({"a": rng.integers(0, 40, 600), "b": rng.integers(40, 80, 600), "w": rng.integers(0, 9, 600) / 4})
    got = S.lightest_forest(edges)
    root = list(range(80))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    want = set()
    for w, a, b in sorted(zip(edges["w"], edges["a"], edges["b"])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    assert set(got.itertuples(index=False, name=None)) == want and len(got) == len(want)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("rank", [1, 40])
def test_a_guess_that_is_too_small_loses_no_neighbour(spark, monkeypatch, metric, rank):
    """the sample narrows what is looked for; points it fails are looked for once more."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(260, 6)).astype(np.float32), np.zeros((2, 6)), np.repeat(rng.normal(size=(1, 6)).astype(np.float32), 12, axis=0)])
    used = []

    def sample(pts, cells, k):
        used.append(C.placed(x[:200], metric))
        return used[-1], rank

    monkeypatch.setattr(D, "_sample", sample)
    rows = knn_graph(_frame(spark, x, kind="float"), "id", "vec", k=7, metric=metric, block_size=32).collect()
    d = np.round(C.distances(x, x, metric), 12)
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["nbr"])
    assert used and got == {i: [j for _, j in sorted((v, j) for j, v in enumerate(row) if j != i)[:7]] for i, row in enumerate(d)}


def test_a_sample_is_taken_of_larger_tables_only(spark):
    x = np.random.default_rng(8).normal(size=(2000, 3))
    pts, cells = C.make_cells(_frame(spark, x), "id", "vec", block_size=64)
    sample, rank = D._sample(pts, cells, 5)
    assert sample.shape == (250, 3) and rank == 6
    assert D._sample(pts.withColumn("id", pts["id"] % 1000), cells, 5) is None  # lists are by id
    small, few = C.make_cells(_frame(spark, x[:50]), "id", "vec", block_size=16)
    assert D._sample(small, few, 5) is None
