"""M4 / M7 against brute force on a small fixture: two moons plus uniform
noise, 200 points (FIXTURES F9)."""

from __future__ import annotations

import numpy as np
import pytest

from tagwright.operators.density import connected_components, hdbscan, knn_graph
from tagwright.operators.merge_tree import merge_tree


def _moons(n=200, seed=3):
    rng = np.random.default_rng(seed)
    k = (n - 20) // 2
    t = rng.uniform(0, np.pi, k)
    a = np.c_[np.cos(t), np.sin(t)] + rng.normal(scale=0.06, size=(k, 2))
    b = np.c_[1 - np.cos(t), 0.5 - np.sin(t)] + rng.normal(scale=0.06, size=(k, 2))
    noise = rng.uniform([-1.5, -1.0], [2.5, 1.5], size=(n - 2 * k, 2))
    return np.vstack([a, b, noise])


def brute_hdbscan(x: np.ndarray, m: int, ms: int) -> np.ndarray:
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, ms - 1]
    mr = np.maximum(d, np.maximum.outer(core, core))
    edges = sorted((mr[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    parent = list(range(n))

    def find(u):
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        return u

    mst = []
    for w, i, j in edges:
        ri, rj = find(i), find(j)
        if ri != rj:
            parent[ri] = rj
            mst.append((w, i, j))
    levels = sorted({w for w, _, _ in mst}, reverse=True)

    def comps(limit):
        par = list(range(n))

        def f(u):
            while par[u] != u:
                par[u] = par[par[u]]
                u = par[u]
            return u

        for w, i, j in mst:
            if limit is None or w < limit:
                par[f(i)] = f(j)
        return [f(u) for u in range(n)]

    lam = [0.0] + [1.0 / w for w in levels]
    per_level = [comps(None)] + [comps(w) for w in levels]
    cid = {}
    birth, par_of = {}, {}
    nid = 0
    member = {}  # cluster -> {node: last level}
    for lv, lab in enumerate(per_level):
        groups = {}
        for u, c in enumerate(lab):
            groups.setdefault(c, []).append(u)
        big = {c: us for c, us in groups.items() if len(us) >= m}
        if lv == 0:
            for c in big:
                cid[(0, c)] = nid
                birth[nid], par_of[nid] = 0.0, None
                nid += 1
        else:
            prev = per_level[lv - 1]
            kids = {}
            for c, us in big.items():
                kids.setdefault(prev[us[0]], []).append(c)
            for p, cs in kids.items():
                pc = cid.get((lv - 1, p))
                if pc is None:
                    continue
                for c in cs:
                    if len(cs) >= 2:
                        cid[(lv, c)] = nid
                        birth[nid], par_of[nid] = lam[lv], pc
                        nid += 1
                    else:
                        cid[(lv, c)] = pc
        for c, us in big.items():
            k = cid.get((lv, c))
            if k is None:
                continue
            for u in us:
                member.setdefault(k, {})[u] = lv
    stab = {k: sum(lam[min(last + 1, len(levels))] - birth[k] for last in mem.values()) for k, mem in member.items()}
    kids = {}
    for c, p in par_of.items():
        if p is not None:
            kids.setdefault(p, []).append(c)
    sel, sub = set(), {}

    def visit(c):
        for ch in kids.get(c, []):
            visit(ch)
        if par_of[c] is None:
            return
        s = sum(sub[ch] for ch in kids.get(c, []))
        if kids.get(c) and s > stab[c]:
            sub[c] = s
        else:
            sub[c] = stab[c]
            st = list(kids.get(c, []))
            while st:
                y = st.pop()
                sel.discard(y)
                st.extend(kids.get(y, []))
            sel.add(c)

    if member:
        visit(0)
    out = -np.ones(n, dtype=int)
    for i, c in enumerate(sorted(sel)):
        for u in member[c]:
            out[u] = i
    return out


def _same_partition(a, b):
    pa = {(i, j) for i in range(len(a)) for j in range(len(a)) if a[i] == a[j] and a[i] != -1}
    pb = {(i, j) for i in range(len(b)) for j in range(len(b)) if b[i] == b[j] and b[i] != -1}
    return pa == pb and set(np.where(a == -1)[0]) == set(np.where(b == -1)[0])


@pytest.fixture(scope="module")
def moons(spark):
    x = _moons()
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "id long, vec array<double>")
    return x, df


def test_density_clustering_matches_bruteforce(spark, moons):
    x, df = moons
    labels, facts = hdbscan(df, "id", "vec", min_cluster_size=15, min_samples=5, block_size=64)
    got = np.array([r["cluster"] for r in labels.orderBy("id").collect()])
    want = brute_hdbscan(x, 15, 5)
    assert facts["exact_levels"]
    assert facts["cluster_count"] == len(set(want) - {-1}) >= 2
    assert _same_partition(got, want)


def test_knn_graph_exact(spark, moons):
    x, df = moons
    g = knn_graph(df, "id", "vec", k=5, block_size=50)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {i: list(np.lexsort((np.arange(len(x)), d[i]))[:5]) for i in range(len(x))}
    got = {}
    for r in g.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["nbr"])
    assert got == want


def test_connected_components_path(spark):
    n = 40
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, n - 1) if i != 19], "a long, b long")
    cc = {r["node"]: r["comp"] for r in connected_components(nodes, edges).collect()}
    assert {cc[i] for i in range(20)} == {0} and {cc[i] for i in range(20, n)} == {20}


def test_merge_tree_is_the_same_in_parts(spark):
    """Edges with many equal weights: small blocks of edges give the same tree
    as one block, and it is the brute-force one."""
    rng = np.random.default_rng(6)
    n = 300
    edges = [(int(rng.integers(0, i)), i, float(rng.integers(0, 12)) if i % 3 else float(rng.uniform(0, 12))) for i in range(1, n - 1)]
    points = spark.createDataFrame([(i,) for i in range(n)], "id long")
    frame = spark.createDataFrame(edges, "a long, b long, w double")

    def comps(limit):
        label = list(range(n))
        for _ in range(n):
            before = list(label)
            for a, b, w in edges:
                if w <= limit:
                    label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    want = {(i, -1.0, 1) for i in range(n)}
    last = list(range(n))
    for w in sorted({w for *_, w in edges}):
        label = comps(w)
        grown = {c for c, old in zip(label, last) if c != old} | {label[b] for a, b, x in edges if x == w}
        want |= {(c, w, label.count(c)) for c in grown}
        last = label
    trees = [{tuple(r) for r in merge_tree(points, frame, size).collect()} for size in (1 << 16, 20)]
    assert trees[0] == trees[1]
    assert {r[:3] for r in trees[0]} == want
    assert sum(r[3] is None for r in trees[0]) == 2  # the tree and the point without an edge


@pytest.mark.parametrize("n", [700, 2000])
def test_same_method_at_every_size(spark, n):
    x = _moons(n)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "id long, vec array<double>")
    labels, facts = hdbscan(df, "id", "vec", min_cluster_size=15, min_samples=5, block_edges=100)
    got = np.array([r["cluster"] for r in labels.orderBy("id").collect()])
    if n == 700:
        assert _same_partition(got, brute_hdbscan(x, 15, 5))
    assert facts["cluster_count"] == got.max() + 1 >= 2
    assert facts["noise_count"] == (got == -1).sum() < n / 4


def test_copies_and_small_tables(spark):
    x = np.repeat(np.array([[0.0, 0.0], [5.0, 5.0], [9.0, 0.0]]), [30, 30, 1], axis=0)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    labels, facts = hdbscan(df, "id", "vec", min_cluster_size=10, min_samples=3)
    got = [r["cluster"] for r in labels.orderBy("id").collect()]
    assert got == [0] * 30 + [1] * 31  # the lone point falls out of the second cluster only later
    for k in (0, 1, 4):
        labels, facts = hdbscan(df.limit(k), "id", "vec", min_cluster_size=10, min_samples=3)
        assert labels.count() == facts["noise_count"] == k and facts["cluster_count"] == 0


def test_excess_of_mass_on_deep_trees(spark):
    from tagwright.operators.merge_tree import _excess_of_mass

    rng = np.random.default_rng(4)
    rows = [(0, None, 1.0)]
    for i in range(1, 120):  # a long chain with a leaf at every second step, then a bush
        rows.append((i, i - 1 if i < 80 else int(rng.integers(0, i)), float(rng.integers(0, 9))))
    rows += [(200 + i, i, float(rng.integers(0, 9))) for i in range(0, 80, 2)]
    kids = {}
    for i, p, _ in rows:
        kids.setdefault(p, []).append(i)
    own = {i: s for i, _, s in rows}

    def value(i):
        return max(own[i], sum(value(k) for k in kids.get(i, [])))

    got = {r["id"]: r["value"] for r in _excess_of_mass(spark.createDataFrame(rows, "id long, parent long, own double")).collect()}
    assert got == {i: value(i) for i in own}
