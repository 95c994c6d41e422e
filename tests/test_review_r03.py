"""Findings of round 3."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tagwright.operators import cells as C
from tagwright.operators.density import core_distances, mutual_reachability_mst


def _frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, vec array<double>")


def _tree(x, ids, core):
    d = C.distances(x, x)
    w = np.maximum(d, np.maximum.outer(core, core))
    pairs = sorted((w[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(x)) for j in range(i))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    out = set()
    for _, a, b in pairs:
        p, q = find(a), find(b)
        if p != q:
            root[p] = q
            out.add((a, b))
    return out


def test_a_point_is_sent_once_a_group(spark):
    """not once for every block."""
    x = np.random.default_rng(1).normal(size=(600, 5))
    pts, cells = C.make_cells(_frame(spark, x), "id", "vec", block_size=8)
    sent = C.visitors(pts, cells, lambda b, to_pivot: np.ones(to_pivot.shape, dtype=bool), ["id"], "id long")
    groups = int(cells.groups.max()) + 1
    assert groups <= C.GROUPS + 1 < cells.blocks.sum()
    assert sent.count() == len(x) * groups


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_groups_of_blocks_give_the_nearest_points(metric):
    """bounds by matrix products far from the origin lose no neighbour."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(60, 3)) + 1e4, np.full((30, 3), 1e4), np.zeros((3, 3))])
    rows = pd.DataFrame({"id": rng.permutation(len(x)), "vec": list(x), "cell": np.arange(len(x)) % 4, "block": 0, "limit": np.inf})
    left, right = rows[rows["cell"] < 2], rows[rows["cell"] >= 2]
    got = C.nearest_across(left, right, 4, metric)
    for one, two in ((left, right), (right, left)):
        d = np.round(C.distances(np.stack(one["vec"]), np.stack(two["vec"]), metric), 12)
        for i, row in zip(one["id"], d):
            want = [j for _, j in sorted(zip(row, two["id"]))[:4]]
            assert sorted(got[got["id"] == i]["nbr"]) == sorted(want)


def test_spanning_tree_with_copies_and_far_clusters(spark):
    """Copies are leaves, clusters without a known way out look for one."""
    rng = np.random.default_rng(3)
    lumps = [rng.normal(size=(n, 2)) + c for n, c in ((50, [0, 0]), (40, [300, 0]), (45, [0, 500]))]
    grid = rng.integers(0, 5, size=(60, 2)).astype(float) + [0.0, 100.0]
    x = np.vstack([*lumps, grid, np.repeat([[7.0, 7.0]], 25, axis=0)])
    ids = rng.permutation(len(x))
    core = np.sort(C.distances(x, x), axis=1)[:, 2]
    points, edges = mutual_reachability_mst(_frame(spark, x, ids), "id", "vec", 3, block_size=16)
    assert {r["id"]: r["core"] for r in points.collect()} == pytest.approx(dict(zip(ids.tolist(), core)))
    assert {(r["a"], r["b"]) for r in edges.collect()} == _tree(x, ids.tolist(), core)


def test_repeated_rows_keep_their_neighbours(spark):
    x = np.array([[0.0], [1.0], [3.0], [3.0]])
    df = _frame(spark, x, [5, 6, 7, 8])
    twice = df.unionByName(df)
    got = {r["id"]: r["core"] for r in core_distances(twice, "id", "vec", 3).collect()}
    tree = mutual_reachability_mst(twice, "id", "vec", 3)
    assert {r["id"]: r["core"] for r in tree[0].collect()} == got
    assert {(r["a"], r["b"]) for r in tree[1].collect()} == {(5, 6), (6, 7), (7, 8)}


def test_training_folders_come_from_one_join(spark, monkeypatch):
    """The table is joined once, not for each folder."""
    from tests.conftest import SF0001
    from tagwright.plans import q_ml

    plans, write = [], q_ml.sk.write_parquet
    monkeypatch.setattr(q_ml.sk, "write_parquet", lambda df, path: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, path)))
    train, _ = q_ml._training(spark, SF0001)
    assert train.count() and len(plans) == 10 and not any("Join" in p for p in plans)


def test_phrases_and_lines_with_odd_letters(spark):
    """the substring search passes over texts, never over a match."""
    from tagwright.functions import text as tx

    texts = ["MAY it", "mıght Know", "MİGHT", "poſſibly", "mayor mayor", "", " \n  a\n\nb\r\n \x1f c", "It DEPENDS!? ok...", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select(
        "i", tx.phrase_count("t", tx.rx.HEDGING), tx.phrase_flag("t", tx.rx.CLARIFICATION), tx.line_count("t"), tx.sentence_count("t"), tx.word_count("t"),
        tx._holds_none(tx._c("t"), tx.rx.HEDGING),
    ).orderBy("i").collect()
    assert [r[1] for r in rows] == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, None]
    assert [r[2] for r in rows] == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, None]
    assert [r[3] for r in rows[:8]] == [1, 1, 1, 1, 1, 1, 3, 1]
    assert [r[4] for r in rows[:8]] == [1, 1, 1, 1, 1, 1, 1, 2]
    assert [r[5] for r in rows[:8]] == [2, 2, 1, 1, 2, 0, 3, 3]
    assert [r[6] for r in rows[:8]] == [False, False, False, False, False, True, True, False]


def test_top_terms_order_places_of_listed_terms_only(spark):
    """ties by first place, null clusters, fewer terms than asked for."""
    from tagwright.operators.profile import top_terms

    rows = [(0, 2, "bb aa aa"), (0, 1, "cc bb dd"), (None, 1, "zz yy"), (None, 2, "yy"), (1, 1, None), (2, 1, "of the")]
    df = spark.createDataFrame(rows, "cluster int, row int, assistant_output string")
    got = {(r["cluster"], r["rank"]): (r["term"], r["count"]) for r in top_terms(df, ["row"], limit=3).collect()}
    assert got == {(0, 1): ("bb", 2), (0, 2): ("aa", 2), (0, 3): ("cc", 1), (None, 1): ("yy", 2), (None, 2): ("zz", 1)}


def test_few_rows_and_tokens_are_held(spark):
    """a worker holds some megabytes of rows and tokens, whatever the table."""
    from tagwright.operators import embed

    df = spark.createDataFrame([(i, f"word{i} word") for i in range(3000)], "id long, t string").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = embed.with_hashed_embedding(df, "id", "t")
    assert out.count() == 3000 and embed.unit_norm_violations(out) == 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert embed.KNOWN_TOKENS <= 1 << 16
