"""Spanning forests of lists of edges, in one task each.

Edges are in the order ``(weight, smaller id, larger id)``, a total one, so a
forest is unique.  An edge that is not in the forest of some of the edges is
the last one of a circle and in no tree: :func:`lightest_forest` makes a
list short and keeps the lightest edge that leaves any set of points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .merge_tree import followed


def ordered(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.lexsort((np.maximum(a, b), np.minimum(a, b), w))


def rounds(
    comp: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, radius: np.ndarray, searched: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Components (positions of one of their points) and positions of the edges
    that join them, after rounds in which each component takes its lightest
    edge if that is lighter than its ``radius``.  The edges come in order; of
    ``searched`` components the lightest is among them in any case."""
    n, comp, low = len(radius), comp.copy(), radius.copy()
    np.minimum.at(low, comp, radius)
    at = np.arange(len(w))
    out: list[np.ndarray] = []
    known = np.zeros(n, dtype=bool) if searched is None else searched
    while len(at):
        ca, cb = comp[a[at]], comp[b[at]]
        apart = ca != cb
        at, ca, cb = at[apart], ca[apart], cb[apart]
        best = np.full(n, -1)
        both = np.stack([ca, cb], axis=1).ravel()[::-1]
        best[both] = np.repeat(np.arange(len(at)), 2)[::-1]  # the last to be written is the lightest
        has = np.flatnonzero(best >= 0)
        e = best[has]
        sure = (w[at[e]] < low[has]) | known[has]
        has, e = has[sure], e[sure]
        if not len(has):
            break
        out.append(np.unique(at[e]))
        step = np.arange(n)
        step[has] = np.where(ca[e] == has, cb[e], ca[e])
        two = (step[step] == np.arange(n)) & (step > np.arange(n))  # both took the same edge
        step[two] = np.flatnonzero(two)
        step = followed(step)
        np.minimum.at(low, step, low)
        comp = step[comp]
        known = np.zeros(n, dtype=bool)
    return comp, np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def lightest_forest(edges: pd.DataFrame) -> pd.DataFrame:
    """``a, b, w``: the forest of the edges."""
    a, b, w = (edges[c].to_numpy() for c in ("a", "b", "w"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = ordered(a, b, w)
    at = at.reshape(2, -1)[:, order]
    _, kept = rounds(np.arange(len(ids)), at[0], at[1], w[order], np.full(len(ids), np.inf))
    kept = order[kept]
    return pd.DataFrame({"a": a[kept], "b": b[kept], "w": w[kept]})


#: rows of :func:`joined`, by kind
POINT, TREE, KNOWN, COMPONENT = range(4)
JOINED = "kind int, a long, b long, w double, comp long, n long"


def joined(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """All rounds in which the known edges prove themselves: points ``id, comp,
    radius`` and edges ``a, b, w, of, searched`` (where ``searched``, the lightest
    that leaves the component ``of``) give :data:`JOINED` rows: points ``a, comp`` with the
    radius ``w``; new edges of the tree; the other edges between components; and
    components with ``n`` points and their lightest known edge."""
    points = points.sort_values("id", kind="stable")
    ids, radius = points["id"].to_numpy(), points["radius"].to_numpy(dtype=float)
    comp = np.searchsorted(ids, points["comp"].to_numpy())
    a, b, w = (edges[c].to_numpy() for c in ("a", "b", "w"))
    order = ordered(a, b, w)
    a, b, w = np.searchsorted(ids, a[order]), np.searchsorted(ids, b[order]), w[order].astype(float)
    # no edge that leaves a component is lighter than its lightest
    least = np.full(len(ids), -np.inf)
    found = edges[edges["searched"].to_numpy(dtype=bool)]
    np.maximum.at(least, np.searchsorted(ids, found["of"].to_numpy()), found["w"].to_numpy(dtype=float))
    radius = np.maximum(radius, least[comp])
    comp, tree = rounds(comp, a, b, w, radius, least > -np.inf)
    name = np.full(len(ids), len(ids))
    np.minimum.at(name, comp, np.arange(len(ids)))
    comp = name[comp]
    left = np.flatnonzero(comp[a] != comp[b])
    comps, sizes = np.unique(comp, return_counts=True)
    best = np.full(len(ids), -1)
    best[np.stack([comp[a[left]], comp[b[left]]], axis=1).ravel()[::-1]] = np.repeat(left, 2)[::-1]
    e = best[comps]
    has = e >= 0
    lo, hi = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])

    def some(kind: int, rows: int, /, **columns) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.full(rows, kind, dtype=np.int32)} | columns)

    none = pd.array([pd.NA], dtype="Int64")
    out = [
        some(POINT, len(ids), a=ids, w=radius, comp=ids[comp]),
        some(TREE, len(tree), a=lo[tree], b=hi[tree], w=w[tree]),
        some(KNOWN, len(left), a=lo[left], b=hi[left], w=w[left]),
        some(COMPONENT, int(has.sum()), a=lo[e[has]], b=hi[e[has]], w=w[e[has]], comp=ids[comps[has]], n=sizes[has]),
        some(COMPONENT, int((~has).sum()), comp=ids[comps[~has]], n=sizes[~has]),
    ]
    for part in out:
        for c in ("a", "b", "comp", "n"):
            part[c] = part[c].astype("Int64") if c in part else none.repeat(len(part))
        part["w"] = part["w"] if "w" in part else np.nan
    return pd.concat(out)[[c.split()[0] for c in JOINED.split(", ")]]
