"""The single-linkage merge tree of a spanning forest, and clusters from it.

The tree holds every distinct weight: a node is ``(rep, top)``, the smallest
point id under it and the weight at which its children merged (-1 for a
point); parts that merge at one weight have one common parent.

:func:`merge_tree` divides the sorted edges: below a middle weight they form
components, each a problem of its own, and the edges from it on join the
contracted components, one more problem.  All problems of a round are
contracted together, so the rounds grow with the logarithm of the edges;
problems of at most ``block_edges`` edges are merged in one task.

A whole tree of at most :data:`ONE_TASK` points needs none of these rounds:
:func:`labels_of_tree` works out merge tree, clusters and choice in one task.

The clusters come from the tree by aggregation and by :func:`climb`, which
follows parent pointers in doubling steps.  Every loop ends by itself or
raises; nothing but change flags reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release

BLOCK_EDGES = 1 << 16
ONE_TASK = 1 << 20
NODE = "rep long, top double, size long, prep long, pw double"


def merge_sorted(reps, tops, sizes, a, b, w) -> list[tuple]:
    """``NODE`` rows of a forest: every node with its parent, roots left out.
    ``a`` and ``b`` are positions; edges of one weight merge at once."""
    order = np.argsort(w, kind="stable")
    a, b, w = a[order].tolist(), b[order].tolist(), w[order].tolist()
    reps, tops, sizes = reps.tolist(), tops.tolist(), sizes.tolist()
    up = list(range(len(reps)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out, i = [], 0
    while i < len(w):
        merged: dict[int, list[int]] = {}
        weight = w[i]
        while i < len(w) and w[i] == weight:
            x, y = find(a[i]), find(b[i])
            i += 1
            if x == y:
                continue
            left, right = merged.pop(x, [x]), merged.pop(y, [y])
            if len(left) < len(right):
                x, y, left, right = y, x, right, left
            left.extend(right)
            merged[x] = left
            up[y] = x
        for root, parts in merged.items():
            rep, size = min(reps[p] for p in parts), sum(sizes[p] for p in parts)
            out.extend((reps[p], tops[p], sizes[p], rep, weight) for p in parts)
            reps[root], tops[root], sizes[root] = rep, weight, size
    return out


def followed(step: np.ndarray) -> np.ndarray:
    """Where each position ends that follows ``step``, by doubling."""
    while True:
        ahead = step[step]
        if (ahead == step).all():
            return step
        step = ahead


def labels_of_tree(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, min_size: int) -> np.ndarray:
    """The label of each of ``n`` points, in the order of their ids, from the
    edges of a forest over their positions: what :func:`merge_tree`,
    :func:`condensed_clusters` and :func:`select_clusters` give (-1: none)."""
    if min_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    order = np.argsort(w, kind="stable")
    w = w[order]
    m = len(w)
    up, size, rep = list(range(n + m)), [1] * n + [0] * m, list(range(n + m))
    above = np.arange(n + m)
    for new, x, y in zip(range(n, n + m), a[order].tolist(), b[order].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[x] = up[y] = above[x] = above[y] = new
        size[new], rep[new] = size[x] + size[y], min(rep[x], rep[y])
    size, rep, at = np.array(size), np.array(rep), np.arange(n + m)
    weight = np.concatenate([np.full(n, -1.0), w])
    root = above == at
    # merges of one weight are one node, named by the last of them
    head = followed(np.where(weight[above] == weight, above, at))
    parent = head[above]
    node, root = head == at, root[head]
    big = node & (size >= min_size)
    big_children = np.bincount(parent[big & ~root], minlength=n + m)
    starts = big & (root | (big_children[parent] >= 2))
    cluster = followed(np.where(big & ~starts, parent, at))
    least = w[w > 0].min(initial=np.inf)
    density = 1.0 / np.maximum(w, least if np.isfinite(least) else 1.0)
    density = np.concatenate([np.zeros(n), density])
    birth = np.where(root, 0.0, density[above])
    gain = np.zeros(n + m)
    fallen = np.flatnonzero(node & ~big & ~root & big[parent])
    np.add.at(gain, cluster[parent[fallen]], birth[fallen] * size[fallen])
    born = np.flatnonzero(starts & ~root)
    np.add.at(gain, cluster[parent[born]], birth[born] * size[born])
    # a node comes after all below it
    found = np.flatnonzero(starts).tolist()
    below: dict[int, float] = {}
    better = set()
    for c in found:
        own = gain[c] - birth[c] * size[c]
        if c in below and below[c] > own * (1 + 1e-12):
            better.add(c)
        if not root[c]:
            p = int(cluster[parent[c]])
            below[p] = below.get(p, 0.0) + max(own, below.get(c, own))
    chosen = np.full(n + m, -1)
    for c in reversed(found):
        if not root[c]:
            held = chosen[cluster[parent[c]]]
            chosen[c] = held if held >= 0 or c in better else c
    names = np.unique(chosen[chosen >= 0])
    number = np.full(n + m, -1)
    number[names[np.argsort(rep[names], kind="stable")]] = np.arange(len(names))
    last = followed(np.where(big | root, at, parent))[:n]
    held = np.where(big[last], chosen[cluster[last]], -1)
    return np.where(held >= 0, number[held], -1)


def _merged_in_tasks(nodes: DataFrame, edges: DataFrame, n_edges: int, block_edges: int) -> DataFrame:
    buckets = F.pmod(F.xxhash64("sub"), F.lit(max(1, math.ceil(n_edges / block_edges))))

    def solve(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        at = n[["sub", "rep"]].assign(i=np.arange(len(n)))
        ends = [e.merge(at, left_on=["sub", side], right_on=["sub", "rep"])[["e", "i"]].set_index("e")["i"] for side in ("a", "b")] if len(e) else []
        if not ends:
            return pd.DataFrame([], columns=[c.split()[0] for c in NODE.split(", ")])
        a, b = (s.reindex(range(len(e))).to_numpy(np.int64) for s in ends)
        rows = merge_sorted(n["rep"].to_numpy(), n["top"].to_numpy(), n["size"].to_numpy(), a, b, e["w"].to_numpy())
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])

    def numbered(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        return solve(n, e.assign(e=np.arange(len(e))))

    left = nodes.withColumn("bucket", buckets).groupBy("bucket")
    return left.cogroup(edges.withColumn("bucket", buckets).groupBy("bucket")).applyInPandas(numbered, NODE)


def merge_tree(points: DataFrame, edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``NODE`` rows of all nodes; a root has no parent.  ``points`` has
    ``id``; ``edges`` has ``a, b, w``, forms a forest over them, and its weights
    are not negative."""
    from .density import connected_components

    leaf = points.select(F.col("id").alias("rep"), F.lit(-1.0).alias("top"), F.lit(1).cast("long").alias("size"))
    nodes = leaf.withColumn("sub", F.lit(""))
    edges = cut_lineage(edges.select(F.lit("").alias("sub"), "a", "b", F.col("w").cast("double").alias("w")))
    out: list[DataFrame] = []
    while True:
        stats = cut_lineage(
            edges.groupBy("sub").agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.percentile_approx("w", 0.5).alias("mid"))
        )
        small, large = stats.where(F.col("n") <= block_edges), stats.where(F.col("n") > block_edges)
        n_small = small.agg(F.sum("n")).first()[0] or 0
        if n_small:
            own = small.select("sub")
            out.append(cut_lineage(_merged_in_tasks(nodes.join(own, "sub", "left_semi"), edges.join(own, "sub", "left_semi"), n_small, block_edges)))
        if not large.count():
            break
        equal = large.where("lo = hi").select("sub", F.col("hi").alias("pw"))
        parent = nodes.groupBy("sub").agg(F.min("rep").alias("prep")).join(equal, "sub")
        out.append(cut_lineage(nodes.join(parent, "sub").select("rep", "top", "size", "prep", "pw")))

        cut = large.where("lo < hi").select("sub", "mid", "hi")
        nodes, weighed = nodes.join(cut.select("sub"), "sub", "left_semi"), edges.join(cut, "sub")
        below = (F.col("w") < F.col("hi")) & (F.col("w") <= F.col("mid"))  # at least one edge on either side
        low = cut_lineage(weighed.where(below).select("sub", "a", "b", "w"))
        high = weighed.where(~below).select("sub", "a", "b", "w")
        comps = connected_components(nodes.select("sub", F.col("rep").alias("node")), low, ["sub"])
        of = lambda side: comps.select("sub", F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
        inside = low.join(of("a"), ["sub", "a"])
        tops = inside.groupBy("sub", F.col("ca").alias("comp")).agg(F.max("w").alias("within"))
        placed = nodes.join(comps.withColumnRenamed("node", "rep"), ["sub", "rep"]).join(tops, ["sub", "comp"], "left")
        upper = placed.groupBy("sub", "comp").agg(F.sum("size").alias("size"), F.max(F.coalesce("within", "top")).alias("top"))
        lower_name = lambda comp: F.concat("sub", F.lit("l"), F.col(comp).cast("string"))
        upper_name = F.concat("sub", F.lit("h"))
        next_nodes = placed.where("within is not null").select("rep", "top", "size", lower_name("comp").alias("sub")).unionByName(
            upper.select(F.col("comp").alias("rep"), "top", "size", upper_name.alias("sub"))
        )
        next_edges = inside.select("a", "b", "w", lower_name("ca").alias("sub")).unionByName(
            high.join(of("a"), ["sub", "a"]).join(of("b"), ["sub", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w", upper_name.alias("sub"))
        )
        old = [edges, nodes, stats, comps, low]
        nodes, edges = cut_lineage(next_nodes), cut_lineage(next_edges)
        for frame in old:
            release(frame)
    rows = out[0] if out else points.sparkSession.createDataFrame([], NODE)
    for more in out[1:]:
        rows = rows.unionByName(more)
    tops = rows.groupBy(F.col("prep").alias("rep"), F.col("pw").alias("top")).agg(F.sum("size").alias("size"))
    none = [F.lit(None).cast("long").alias("prep"), F.lit(None).cast("double").alias("pw")]
    roots = tops.unionByName(leaf).join(rows.select("rep", "top"), ["rep", "top"], "left_anti").select("rep", "top", "size", *none)
    return rows.unionByName(roots)


def climb(chain: DataFrame) -> DataFrame:
    """``id, top`` from ``id, up, top``: the ``top`` of the highest row that has
    one on the way from each row over ``up`` (null at the end)."""
    for r in range(33):
        if not chain.where("up is not null").limit(1).count():
            return chain.select("id", "top")
        step = chain
        for _ in range(2):  # two doublings for a written table
            look = step.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
            step = step.join(look, "up", "left").select("id", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"))
        old, chain = chain, cut_lineage(step)
        if r:
            release(old)
    raise RuntimeError("parent pointers run in a circle")


def _excess_of_mass(clusters: DataFrame) -> DataFrame:
    """``id, value`` with ``value = max(own, sum of the children's values)``
    from ``id, parent, own``.  Rounds resolve rows whose children are known;
    a row with one open child is a step ``x -> max(a, x + b)``, and such steps
    are composed along chains, so the rounds grow with the logarithm."""
    state = clusters.select(
        "id", "parent", "own", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("a"),
        F.lit(None).cast("double").alias("b"), F.lit(None).cast(clusters.schema["id"].dataType).alias("child"),
    )
    written = None
    for _ in range(200):
        state = cut_lineage(state)
        release(written)
        written = state
        if not state.where("value is null").limit(1).count():
            return state.select("id", "value")
        known = F.col("value").isNotNull()
        below = state.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.sum("value").alias("sum"), F.sum((~known).cast("int")).alias("open"), F.min(F.when(~known, F.col("id"))).alias("one")
        )
        s = state.join(below, "id", "left")
        open_ = F.coalesce("open", F.lit(0))
        total = F.coalesce("sum", F.lit(0.0))
        s = s.select(
            "id", "parent", "own",
            F.coalesce("value", F.when(open_ == 0, F.greatest("own", total))).alias("value"),
            F.coalesce("a", F.when(open_ == 1, F.col("own"))).alias("a"),
            F.coalesce("b", F.when(open_ == 1, total)).alias("b"),
            F.coalesce("child", F.when(open_ == 1, F.col("one"))).alias("child"),
        )
        look = s.select(F.col("id").alias("child"), F.col("value").alias("v2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("child").alias("child2"))
        step = s.join(look, "child", "left")
        on = F.col("v2").isNull() & F.col("child2").isNotNull()
        state = step.select(
            "id", "parent", "own",
            F.coalesce("value", F.when(F.col("v2").isNotNull(), F.greatest("a", F.col("v2") + F.col("b")))).alias("value"),
            F.when(on, F.greatest("a", F.col("a2") + F.col("b"))).otherwise(F.col("a")).alias("a"),
            F.when(on, F.col("b") + F.col("b2")).otherwise(F.col("b")).alias("b"),
            F.when(on, F.col("child2")).otherwise(F.col("child")).alias("child"),
        )
    raise RuntimeError("the cluster tree did not settle")


def _key(rep: str, top: str) -> Column:
    return F.when(F.col(top).isNotNull(), F.struct(F.col(rep).alias("rep"), F.col(top).alias("top")))


def condensed_clusters(tree: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """From the rows of :func:`merge_tree`: clusters ``id, parent, size, birth,
    own`` (``own`` is the stability, the root's ``parent`` is null), and
    ``rep, cluster``, the cluster that each point leaves last (null: none).

    A node of at least ``min_size`` points starts a cluster where it is a root
    or has a sibling of that size, else it goes on with its parent's.  A zero
    weight counts as the smallest positive one, so densities are finite."""
    if min_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    least = tree.where("pw > 0").agg(F.min("pw")).first()[0] or 1.0
    density = lambda w: 1.0 / F.greatest(w, F.lit(least))
    big = F.col("size") >= min_size
    keyed = tree.select("rep", "top", "size", "pw", _key("rep", "top").alias("id"), _key("prep", "pw").alias("up"))
    siblings = keyed.where(big & F.col("up").isNotNull()).groupBy("up").agg(F.count("*").alias("big_children"))
    large = keyed.where(big).join(siblings, "up", "left")
    starts = F.col("up").isNull() | (F.col("big_children") >= 2)
    large = cut_lineage(large.select("id", "up", "size", "pw", starts.alias("starts")))
    of = cut_lineage(climb(large.select("id", F.when(~F.col("starts"), F.col("up")).alias("up"), F.when(F.col("starts"), F.col("id")).alias("top"))))
    parents = of.select(F.col("id").alias("up"), F.col("top").alias("parent"))
    begun = large.where("starts").join(parents, "up", "left").select(
        "id", "parent", "size", F.when(F.col("up").isNull(), F.lit(0.0)).otherwise(density(F.col("pw"))).alias("birth")
    )
    fallen = keyed.where(~big).join(parents, "up").select(F.col("parent").alias("id"), (density(F.col("pw")) * F.col("size")).alias("gain"))
    born = begun.where("parent is not null").select(F.col("parent").alias("id"), (F.col("birth") * F.col("size")).alias("gain"))
    gains = fallen.unionByName(born).groupBy("id").agg(F.sum("gain").alias("gain"))
    clusters = cut_lineage(begun.join(gains, "id", "left").withColumn("own", F.coalesce("gain", F.lit(0.0)) - F.col("birth") * F.col("size")).drop("gain"))
    # a point's lowest large ancestor, by its chain of small nodes
    small = keyed.where(~big).join(large.select(F.col("id").alias("up"), F.lit(True).alias("is_big")), "up", "left")
    held = F.coalesce("is_big", F.lit(False))
    first = climb(cut_lineage(small.select("id", F.when(~held, F.col("up")).alias("up"), F.when(held, F.col("up")).alias("top"))))
    points = first.where(F.col("id.top") == -1.0).select(F.col("id.rep").alias("rep"), F.col("top").alias("up"))
    return clusters, points.join(parents, "up", "left").select("rep", F.col("parent").alias("cluster"))


def select_clusters(clusters: DataFrame) -> DataFrame:
    """``id, chosen``: the cluster chosen by excess of mass that holds each
    cluster (null: none); a root is never chosen."""
    values = _excess_of_mass(clusters.select("id", "parent", "own"))
    sums = clusters.select("id", "parent").join(values, "id").where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("value").alias("sum"))
    c = clusters.select("id", "parent", "own").join(sums, "id", "left")
    better = F.col("sum").isNotNull() & (F.col("sum") > F.col("own") * (1 + 1e-12))
    root = F.col("parent").isNull()
    return climb(
        cut_lineage(c.select("id", F.col("parent").alias("up"), F.when(~root & ~better, F.col("id")).alias("top")))
    ).withColumnRenamed("top", "chosen")
