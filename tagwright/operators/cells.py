"""Cells around pivots: exact neighbour passes that skip what a bound rules out.

Up to :data:`MAX_PIVOTS` points are pivots (the smallest id hashes); every
point lies in the cell of its nearest pivot, and a cell of more than
``block_size`` points is dealt by id hash into blocks, so no task holds a hot
cell.  With ``lo`` / ``hi`` the least and largest distance of a cell's points
to their pivot ``p``, and ``h`` the distance of a point ``x`` to its own
pivot, every ``y`` of the cell obeys

    d(x, y) >= max(d(x, p) - hi, lo - d(x, p), (d(x, p) - h) / 2)

Consecutive blocks form groups of at most :data:`MAX_GROUP` points (and about
:data:`GROUPS` groups, while that is more than a block each).  A pass first
looks into each point's own block, which gives a limit that the answer can't
exceed; then groups meet in pairs, if the bound lets a point of one reach the
other, and inside a pair blocks that no limit reaches are passed over.  So a
point is sent once a group and not once a block.

Blocks are compared by one product of single-precision matrices, whose result
less its largest rounding error is a lower bound of the squared distances;
the few pairs within a limit are then worked out exactly (:func:`exact`).  The
result is exact for any data; how much is skipped depends on how clustered it
is (in the worst case nothing, which is the work of comparing all blocks).

The driver holds the pivots and four numbers a cell, bounded by
:data:`MAX_PIVOTS` and :data:`PIVOT_BYTES`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_PIVOTS = 4096
PIVOT_BYTES = 16 << 20
MAX_GROUP = 32768
GROUPS = 24
TILE = 1024
GATHER = 1 << 16
_SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        na = np.linalg.norm(a, axis=1, keepdims=True)
        nb = np.linalg.norm(b, axis=1, keepdims=True)
        sim = (a / np.where(na > 0, na, 1)) @ (b / np.where(nb > 0, nb, 1)).T
        return np.clip(1.0 - sim, 0.0, 2.0)
    out = np.empty((a.shape[0], b.shape[0]))
    step = max(1, 2_000_000 // max(1, b.shape[0] * a.shape[1]))
    for s in range(0, a.shape[0], step):
        diff = a[s : s + step, None, :] - b[None, :, :]
        out[s : s + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Points of a Euclidean space whose distance ``e`` orders like the metric:
    for cosine the unit vectors, ``e^2 / 2`` being the distance; a zero vector
    gets an axis of its own, at distance 1 from all others."""
    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.hstack([x / np.where(norm > 0, norm, 1), norm == 0])


def stacked(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype(float)


def vector_type(df: DataFrame, vec_col: str = "vec") -> str:
    """Floats are sent as floats; they are compared as doubles either way."""
    return "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"


def places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of few places in a matrix, by its faster way over a flat array."""
    return np.divmod(np.flatnonzero(found), max(1, found.shape[1]))


def first_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Whether a row is among the ``k`` smallest ids of its equal rows: no
    other copy is one of the ``k`` nearest of any point."""
    keys = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel() if x.shape[1] else np.zeros(len(x))
    _, same, counts = np.unique(keys, return_inverse=True, return_counts=True)
    keep = np.ones(len(x), dtype=bool)
    if len(counts) and counts.max() > k:
        order = np.lexsort((ids, same))
        start = np.cumsum(counts) - counts
        keep[order] = np.arange(len(x)) - start[same[order]] < k
    return keep


def to_nearest(e: np.ndarray, sample: np.ndarray, rank: int) -> np.ndarray:
    """Of each row about the distance to the ``rank``-th nearest of the sample."""
    middle = sample.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        s = (sample - middle).astype(np.float32)
        norm, out = np.einsum("ij,ij->i", s, s), np.empty(len(e))
        for at in range(0, len(e), TILE):
            x = (e[at : at + TILE] - middle).astype(np.float32)
            square = norm - 2 * (x @ s.T)
            own = np.einsum("ij,ij->i", x, x)
            out[at : at + TILE] = np.partition(square, rank - 1, axis=1)[:, rank - 1] + own + (len(middle) + 16) * 2.0**-20 * (own + norm.max())
    return np.sqrt(np.maximum(np.nan_to_num(out, nan=np.inf, posinf=np.inf), 0.0))


class Side:
    """Rows of a block or group as matrices, in tiles of at most :data:`TILE`
    rows of one block, each with its middle and radius."""

    def __init__(self, pdf: pd.DataFrame, metric: str, centre: np.ndarray | None = None):
        self.rows = pdf.sort_values(["cell", "block"], kind="stable").reset_index(drop=True)
        self.ids = self.rows["id"].to_numpy()
        x = stacked(self.rows["vec"])
        self.zero = ~x.any(axis=1) if metric == "cosine" else np.zeros(len(x), dtype=bool)
        e = placed(x, metric)
        self.raw, self.metric = x, metric
        self.x = e[:, :-1] if metric == "cosine" else x
        self.centre = e.mean(axis=0) if centre is None else centre
        y = e - self.centre
        self.e = y
        norm = np.einsum("ij,ij->i", y, y)
        self.slack = (y.shape[1] + 16) * 2.0**-22
        low, one = norm * (1 - self.slack), np.ones_like(norm)
        self.norm = norm
        with np.errstate(over="ignore"):
            self.left = np.column_stack([-2 * y, low, one]).astype(np.float32)
            self.right = np.column_stack([y, one, low]).astype(np.float32)
        mark = self.rows["cell"].to_numpy().astype(np.int64) << 32 | self.rows["block"].to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(mark)) + 1
        self.tiles, self.block = [], []
        for s, t in zip([0, *cuts], [*cuts, len(mark)]):
            for u in range(s, t, TILE):
                self.tiles.append(slice(u, min(u + TILE, t)))
                self.block.append(mark[s])
        self.mid = np.array([y[t].mean(axis=0) for t in self.tiles])
        self.radius = np.array([np.sqrt(((y[t] - m) ** 2).sum(axis=1).max()) for t, m in zip(self.tiles, self.mid)])

    def least_to_tiles(self, other: Side) -> np.ndarray:
        """Lower bound of the distance of each row to each tile of ``other``."""
        d = distances(self.e, other.mid) if len(other.tiles) else np.empty((len(self.e), 0))
        return np.maximum(d - other.radius, 0.0) * (1 - 1e-9)

    def squares(self, rows, other: Side, cols) -> np.ndarray:
        """Lower bounds of the squared distances in :func:`placed` space."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self.left[rows] @ other.right[cols].T


def square_limit(limit: np.ndarray, metric: str) -> np.ndarray:
    """What the square in :func:`placed` space of a pair within ``limit`` can't exceed."""
    with np.errstate(over="ignore", invalid="ignore"):
        wide = limit * (1 + 1e-6) + 1e-11
        return (2 * wide if metric == "cosine" else wide * wide).astype(np.float32)


def exact(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """The distances of rows ``i`` of ``a`` and ``j`` of ``b``, pair by pair."""
    out = np.empty(len(i))
    for s in range(0, len(i), GATHER):
        x, y = a.x[i[s : s + GATHER]], b.x[j[s : s + GATHER]]
        if a.metric == "cosine":
            out[s : s + GATHER] = np.clip(1.0 - np.einsum("ij,ij->i", x, y), 0.0, 2.0)
        else:
            diff = x - y
            out[s : s + GATHER] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


@dataclass(frozen=True)
class Cells:
    """Pivots in :func:`placed` space and, per cell, the range of its points'
    distances to the pivot, its points and its blocks."""

    metric: str
    pivots: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    size: np.ndarray
    blocks: np.ndarray
    groups: np.ndarray

    @property
    def first_block(self) -> np.ndarray:
        return np.cumsum(self.blocks) - self.blocks

    def group_of(self) -> np.ndarray:
        """Cells x groups: whether the cell has points in the group."""
        out = np.zeros((len(self.blocks), int(self.groups.max(initial=0)) + 1), dtype=bool)
        out[np.repeat(np.arange(len(self.blocks)), self.blocks), self.groups] = True
        return out

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return distances(placed(x, self.metric), self.pivots)

    def in_metric(self, e: np.ndarray) -> np.ndarray:
        return e * e / 2 if self.metric == "cosine" else e

    def least(self, to_pivot: np.ndarray) -> np.ndarray:
        """Lower bound of the distance from each point to each cell."""
        own = to_pivot.min(axis=1, keepdims=True)
        low = np.maximum(np.maximum(to_pivot - self.hi, self.lo - to_pivot), (to_pivot - own) / 2)
        return self.in_metric(np.maximum(low - _SLACK * (1 + to_pivot), 0.0))

    def most(self, to_pivot: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Upper bound of the distance from each point to any point of each cell."""
        far = self.in_metric(to_pivot + self.hi + _SLACK * (1 + to_pivot))
        if self.metric == "cosine":  # two zero vectors are at distance 1
            far = np.where(~x.any(axis=1, keepdims=True), np.maximum(far, 1.0), far)
        return far

    def kth_most(self, to_pivot: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """A distance within which every point has ``k`` points."""
        far = self.most(to_pivot, x)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.size[order], axis=1) >= k
        first = enough.argmax(axis=1)
        rows = np.arange(len(far))
        return np.where(enough[rows, first], far[rows, order[rows, first]], np.inf)


def make_cells(
    df: DataFrame, id_col: str, vec_col: str, metric: str = "euclidean", block_size: int = 2048, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, Cells | None]:
    """``(id, vec, keep..., cell, block)``, written, and the cells' figures
    (None for an empty table).  Rows without an id or a finite vector take no
    part."""
    kind = vector_type(df, vec_col)
    pts = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"), *keep)
    odd = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    pts = pts.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~odd)
    counts = pts.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not counts["n"]:
        return pts.withColumns({"cell": F.lit(0), "block": F.lit(0)}), None
    room = max(1, PIVOT_BYTES // (8 * (counts["d"] + 1)))
    wanted = min(MAX_PIVOTS, room, max(1, math.ceil(counts["n"] / max(1, block_size))))
    first = pts.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    pivots = np.unique(placed(np.array([r["vec"] for r in first], dtype=float), metric), axis=0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                to_pivot = distances(placed(stacked(b["vec"]), metric), pivots)
                yield b.assign(cell=to_pivot.argmin(axis=1).astype("int32"), at=to_pivot.min(axis=1))

    held = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"id long, vec {kind}, " + (held + ", " if held else "") + "cell int, at double"
    pts = cut_lineage(pts.mapInPandas(assign, schema))
    figures = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()
    m = len(pivots)
    lo, hi, size = np.zeros(m), np.zeros(m), np.zeros(m, dtype=np.int64)
    for r in figures:
        lo[r["cell"]], hi[r["cell"]], size[r["cell"]] = r["lo"], r["hi"], r["n"]
    blocks = -(-size // max(1, block_size))
    dealt = F.get(F.lit([int(b) for b in blocks]), F.col("cell"))
    pts = pts.drop("at").withColumn("block", F.pmod(F.xxhash64("id"), dealt).cast("int"))
    held = np.repeat(size / np.maximum(blocks, 1), blocks)  # points of a block
    room = min(MAX_GROUP, max(block_size, counts["n"] / GROUPS))
    groups = ((np.cumsum(held) - held / 2) // room).astype(np.int64)
    groups = np.unique(groups, return_inverse=True)[1]
    cells = Cells(metric, pivots, lo, hi, size, blocks, groups)
    at = F.get(F.lit([int(b) for b in cells.first_block]), F.col("cell")) + F.col("block")
    return pts.withColumn("grp", F.get(F.lit([int(g) for g in groups]), at)), cells


def visitors(
    points: DataFrame, cells: Cells, allowed: Callable[[pd.DataFrame, np.ndarray], np.ndarray], columns: list[str], schema: str
) -> DataFrame:
    """``points`` with ``to_grp`` for every group with a cell that
    ``allowed(rows, distances to the pivots)`` (points x cells) sends them to."""
    member = cells.group_of().astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 2048):
                b = batch.iloc[s : s + 2048].reset_index(drop=True)
                sent = allowed(b, cells.to_pivots(stacked(b["vec"]))) & (cells.size > 0)
                row, grp = np.nonzero(sent.astype(np.float32) @ member)
                if len(row):
                    yield b[columns].iloc[row].reset_index(drop=True).assign(to_grp=grp.astype("int32"))

    return points.mapInPandas(run, f"{schema}, to_grp int")


class Nearest:
    """The ``k`` nearest found so far of every row of a side."""

    def __init__(self, side: Side, k: int, limit: np.ndarray):
        self.side, self.k, self.limit = side, k, limit.copy()
        self.reach = square_limit(self.limit, side.metric)
        self.reach[side.zero] = -1.0
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, row: np.ndarray, nbr: np.ndarray, dist: np.ndarray, ranked: np.ndarray) -> None:
        self.parts.append((row, nbr, dist, ranked))
        self.held += len(row)
        if self.held > max(1 << 20, 4 * self.k * len(self.limit)):
            self.trim()

    def add_zero(self, other: Side) -> None:
        """A zero vector is at cosine distance 1 from all others."""
        row = np.flatnonzero(self.side.zero)
        if len(row) and len(other.ids):
            nbr = np.sort(other.ids)[: self.k]
            one = np.ones(len(row) * len(nbr))
            self.add(np.repeat(row, len(nbr)), np.tile(nbr, len(row)), one, one)

    def trim(self) -> tuple:
        row, nbr, dist, ranked = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.empty(0, np.int64),) * 2 + (np.empty(0),) * 2
        order = np.lexsort((nbr, ranked, row))
        row, nbr, dist, ranked = row[order], nbr[order], dist[order], ranked[order]
        n = np.bincount(row, minlength=len(self.limit))
        start = np.cumsum(n) - n
        keep = np.arange(len(row)) - start[row] < self.k
        full = np.flatnonzero(n >= self.k)
        self.limit[full] = np.minimum(self.limit[full], ranked[start[full] + self.k - 1])
        at = ~self.side.zero
        self.reach[at] = square_limit(self.limit[at], self.side.metric)
        self.parts, self.held = [(row[keep], nbr[keep], dist[keep], ranked[keep])], int(keep.sum())
        return self.parts[0]

    def frame(self) -> pd.DataFrame:
        row, nbr, dist, _ = self.trim()
        return pd.DataFrame({"id": self.side.ids[row], "nbr": nbr, "dist": dist})


def nearest_in_block(pdf: pd.DataFrame, k: int, metric: str) -> tuple[Side, Nearest]:
    """Of every row the ``k`` nearest rows of the same block, itself included."""
    a = Side(pdf, metric)
    out = Nearest(a, k, np.full(len(a.ids), np.inf))
    kept = np.flatnonzero(first_copies(a.raw, a.ids, k))
    for t in a.tiles:
        low = a.squares(t, a, kept)
        if len(kept) > k:
            kth = np.partition(low, k - 1, axis=1)[:, k - 1]
            reach = kth + 3 * a.slack * (a.norm[t] + a.norm[kept].max())
        else:
            reach = np.full(len(low), np.inf)
        reach = np.where(a.zero[t], -1.0, reach)
        row, col = places(~(low > reach[:, None]))
        row, col = row + t.start, kept[col]
        dist = exact(a, row, a, col)
        out.add(row, a.ids[col], dist, np.round(dist, 12))
    out.add_zero(a)
    return a, out


def nearest_for(left: pd.DataFrame, right: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """``id, nbr, dist``: of every row of ``left`` the ``k`` nearest of ``right``,
    but for its own block, that lie within its ``limit``."""
    a = Side(left, metric)
    b = Side(right, metric, a.centre)
    near = Nearest(a, k, a.rows["limit"].to_numpy(dtype=float))
    kept = first_copies(b.raw, b.ids, k)
    least = a.least_to_tiles(b)
    near.add_zero(b)
    for s, rows in enumerate(a.tiles):
        for t, cols in enumerate(b.tiles):
            if b.block[t] == a.block[s] or not (least[rows, t] ** 2 <= near.reach[rows]).any():
                continue
            i, j = places(~(a.squares(rows, b, cols) > near.reach[rows][:, None]) & kept[cols])
            i, j = i + rows.start, j + cols.start
            dist = exact(a, i, b, j)
            ranked = np.round(dist, 12)
            on = (ranked <= near.limit[i]) & ~a.zero[i]
            near.add(i[on], b.ids[j[on]], dist[on], ranked[on])
    return near.frame()


def nearest_across(left: pd.DataFrame, right: pd.DataFrame | None, k: int, metric: str) -> pd.DataFrame:
    """``id, nbr, dist``: of every row of either group the ``k`` nearest of the
    other one that lie within its ``limit``; of one group (``right`` is None)
    those of its other blocks."""
    a = Side(left, metric)
    b = a if right is None else Side(right, metric, a.centre)
    sides = [a] if right is None else [a, b]
    near = [Nearest(s, k, s.rows["limit"].to_numpy(dtype=float)) for s in sides]
    kept = [first_copies(s.raw, s.ids, k) for s in sides]
    least = [a.least_to_tiles(b), a.least_to_tiles(b) if right is None else b.least_to_tiles(a)]
    near[0].add_zero(b)
    if right is not None:
        near[-1].add_zero(a)
    for s, rows in enumerate(a.tiles):
        for t, cols in enumerate(b.tiles):
            if right is None and (t <= s or a.block[s] == b.block[t]):
                continue
            to_b, to_a = near[0].reach[rows], near[-1].reach[cols]
            go_b, go_a = least[0][rows, t] ** 2 <= to_b, least[1][cols, s] ** 2 <= to_a
            if not (go_b.any() or go_a.any()):
                continue
            low = a.squares(rows, b, cols)
            found = np.zeros(low.shape, dtype=bool)
            if go_b.any():
                found |= ~(low > to_b[:, None]) & kept[-1][cols]
            if go_a.any():
                found |= ~(low > to_a[None, :]) & kept[0][rows][:, None]
            i, j = places(found)
            i, j = i + rows.start, j + cols.start
            dist = exact(a, i, b, j)
            ranked = np.round(dist, 12)
            on = (ranked <= near[0].limit[i]) & kept[-1][j] & ~a.zero[i]
            near[0].add(i[on], b.ids[j[on]], dist[on], ranked[on])
            on = (ranked <= near[-1].limit[j]) & kept[0][i] & ~b.zero[j]
            near[-1].add(j[on], a.ids[i[on]], dist[on], ranked[on])
    return pd.concat([n.frame() for n in near])


def lightest_across(active: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """``comp, w, a, b``: the lightest edge of mutual reachability from the
    active rows of each component to members of another one, if it is within
    the component's ``limit`` (ties to the smaller ids)."""
    a = Side(active, "euclidean")
    b = Side(members, "euclidean", a.centre)
    names, code = np.unique(a.rows["comp"].to_numpy(), return_inverse=True)
    other, comp = b.rows["comp"].to_numpy(), a.rows["comp"].to_numpy()
    core_a, core_b = a.rows["core"].to_numpy(dtype=float), b.rows["core"].to_numpy(dtype=float)
    limit = np.full(len(names), np.inf)
    np.minimum.at(limit, code, a.rows["limit"].to_numpy(dtype=float))
    best: list[tuple | None] = [None] * len(names)
    least = a.least_to_tiles(b)
    for s, rows in enumerate(a.tiles):
        for t, cols in enumerate(b.tiles):
            own = limit[code[rows]]
            go = (least[rows, t] <= own * (1 + 1e-6) + 1e-11) & (core_a[rows] <= own) & (core_b[cols].min() <= own)
            at = np.flatnonzero(go) + rows.start
            if not len(at):
                continue
            low = a.squares(at, b, cols)
            apart = comp[at][:, None] != other[cols][None, :]
            low[~apart] = np.inf
            reach = square_limit(limit[code[at]], "euclidean")
            found = ~(low > reach[:, None]) & apart
            if np.count_nonzero(found) > TILE:  # the lightest there, by upper bounds, narrows the limits first
                high = low + 3 * a.slack * (a.norm[at][:, None] + b.norm[cols][None, :])
                high = np.sqrt(np.maximum(np.nan_to_num(high, nan=np.inf), 0.0))
                high = np.maximum(np.maximum(high, core_a[at][:, None]), core_b[cols][None, :]).min(axis=1)
                np.minimum.at(limit, code[at], high * (1 + 1e-6) + 1e-11)
                reach = square_limit(limit[code[at]], "euclidean")
                found = ~(low > reach[:, None]) & apart
            i, j = places(found & (core_b[cols][None, :] <= limit[code[at]][:, None]))
            i, j = at[i], j + cols.start
            w = np.maximum(exact(a, i, b, j), np.maximum(core_a[i], core_b[j]))
            on = w <= limit[code[i]]
            i, j, w = i[on], j[on], w[on]
            lo, hi = np.minimum(a.ids[i], b.ids[j]), np.maximum(a.ids[i], b.ids[j])
            order = np.lexsort((hi, lo, w, code[i]))
            c = code[i][order]
            for e in order[np.flatnonzero(np.r_[True, c[1:] != c[:-1]])] if len(c) else []:
                edge, n = (w[e], lo[e], hi[e]), code[i[e]]
                if best[n] is None or edge < best[n]:
                    best[n], limit[n] = edge, min(limit[n], w[e])
    held = [(names[n], *e) for n, e in enumerate(best) if e is not None]
    return pd.DataFrame(held, columns=["comp", "w", "a", "b"])
