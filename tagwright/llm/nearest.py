"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product.  Vectors are scaled by the largest norm
and given one more component that makes their length one, queries are
normalised and given a zero there; the Euclidean order of those is the order of
inner products.  A table hashes a vector by ``k`` Gaussian (2-stable)
projections, ``floor((a.x + b) / w)`` each.  A query visits, in every table, its
own bucket and perturbed ones (some projections moved by one step) in the order
of estimated success: the sum of the squared distances from its projections to
the steps' boundaries.  The tables' candidates are merged, and the nearest are
ranked again by the exact inner product of the original vectors.

Every row is indexed.  ``k`` and the number of visited buckets are fitted on a
sample of at most ``SAMPLE`` rows (by hash of the id): the cheapest setting
whose recall on the sample reaches ``target``.  Neighbours are nearer in the
whole table than in a sample, so this errs on the safe side.

Scale: index rows are grouped into blocks of a bucket of about ``BLOCK`` rows,
so a bucket that holds a third of all rows is many blocks; visits are joined to
blocks by bucket, in blocks of queries, and each pair of blocks is one matrix
product.  A task keeps the best ``n`` of each query it has seen and passes only
those on.  Queries that found fewer than ``n`` rows are run against all blocks.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do vectors of another width than the most frequent one; ties
go to the smaller id; repeated ids are candidates of each other only as far as
their ids differ; with fewer than ``n`` candidates all are returned; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

SAMPLE = 4_096
SAMPLE_QUERIES = 192
BLOCK = 2_048
QUERY_BLOCK = 256
TABLES = 2
WIDTH = 2.0
TARGET = 0.96
#: projections per table, and how many of them a visit may move
LADDER = ((4, 4), (6, 6), (8, 8), (12, 4), (16, 3))
MAX_VISITS = 2_000
_HELD = 50_000


@dataclass
class Index:
    """Hash functions and the number of buckets a query visits per table."""

    projections: np.ndarray  # tables x (dims + 1) x k
    shifts: np.ndarray  # tables x k
    moves: np.ndarray  # templates x k, each -1, 0 or 1
    visits: int
    max_norm: float

    def cells(self, table: int, points: np.ndarray) -> np.ndarray:
        return (points @ self.projections[table] + self.shifts[table]) / WIDTH

    def key(self, table: int, cells: np.ndarray) -> np.ndarray:
        k = self.projections.shape[2]
        odd = np.random.default_rng(7 + table).integers(1, 1 << 62, size=k, dtype=np.int64) | 1
        with np.errstate(over="ignore"):
            h = (cells.astype(np.int64) * odd).sum(axis=-1)
            h = (h ^ (h >> 29)) * np.int64(0x2545F4914F6CDD1D)
        return h ^ (h >> 32)

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors / self.max_norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(axis=1)))
        return np.hstack([v, rest[:, None]])

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.hstack([v, np.zeros((len(v), 1))])

    def scores(self, table: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of each query, and the score of every template (less is likelier)."""
        x = self.cells(table, points)
        own = np.floor(x)
        down = (x - own) ** 2
        up = (1.0 - (x - own)) ** 2
        return own, down @ (self.moves == -1).T.astype(float) + up @ (self.moves == 1).T.astype(float)

    def visited(self, table: int, points: np.ndarray) -> np.ndarray:
        """Keys of the visited buckets, queries x visits, likeliest first."""
        own, score = self.scores(table, points)
        n = min(self.visits, len(self.moves))
        best = np.argpartition(score, n - 1, axis=1)[:, :n]
        order = np.take_along_axis(score, best, 1).argsort(axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        return self.key(table, own[:, None, :] + self.moves[best])


def _moves(k: int, moved: int) -> np.ndarray:
    if moved >= k:
        return np.array(list(itertools.product((0, -1, 1), repeat=k)), dtype=np.int8)
    out = []
    for n in range(moved + 1):
        for at in itertools.combinations(range(k), n):
            for signs in itertools.product((-1, 1), repeat=n):
                row = np.zeros(k, dtype=np.int8)
                row[list(at)] = signs
                out.append(row)
    return np.array(out)


def fit_index(sample: np.ndarray, max_norm: float, n: int, rows: int, target: float = TARGET, tables: int = TABLES) -> Index:
    """The cheapest setting of the ladder that reaches the target on the
    sample; ``rows``: size of the whole table, for the cost."""
    d = sample.shape[1]
    asked = sample[:SAMPLE_QUERIES]
    products = asked @ sample.T
    products[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    top = min(n, len(sample) - 1)
    best: tuple[float, Index] | None = None
    for k, moved in LADDER:
        rng = np.random.default_rng(1_000 + k)
        index = Index(rng.normal(size=(tables, d + 1, k)), rng.uniform(0, WIDTH, size=(tables, k)), _moves(k, moved), 1, max_norm)
        points, queries = index.rows(sample), index.queries(asked)
        found = np.full((len(asked), len(sample)), np.inf)  # the visit that meets the row, in its luckiest table
        load = np.zeros((tables, len(asked), len(index.moves)))
        for t in range(tables):
            cells = np.floor(index.cells(t, points))
            own, score = index.scores(t, queries)
            rank = score.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            number = {tuple(m): i for i, m in enumerate(index.moves.tolist())}
            for i in range(len(asked)):
                step = cells - own[i]
                near = np.flatnonzero(np.abs(step).max(axis=1) <= 1)
                of = np.array([number.get(tuple(s), -1) for s in step[near].astype(int).tolist()], dtype=int)
                near, of = near[of >= 0], of[of >= 0]
                at = rank[i, of]
                found[i, near] = np.minimum(found[i, near], at)
                np.add.at(load[t, i], at, 1)
        if top < 1:
            return index
        nearest = np.argpartition(-products, top - 1, axis=1)[:, :top]
        when = np.sort(np.take_along_axis(found, nearest, 1).ravel())
        need = when[int(np.ceil(target * len(when))) - 1]
        if not np.isfinite(need):
            index.visits = min(len(index.moves), MAX_VISITS)
            penalty = 1e18 * (1 + np.mean(~np.isfinite(when)))
        else:
            index.visits = int(need) + 1
            penalty = 1e18 if index.visits > MAX_VISITS else 0.0
        scanned = load[:, :, : index.visits].sum(axis=(0, 2)).mean() / len(sample) * rows
        cost = penalty + scanned + 60.0 * index.visits * tables
        if best is None or cost < best[0]:
            best = cost, index
    return best[1]


def usable(c: Column) -> Column:
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & ok & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, width))


def best_of(products: np.ndarray, queries: np.ndarray, vectors: np.ndarray, qids: np.ndarray, ids: np.ndarray, n: int):
    """For each query its best ``n`` (ids, scores) of a block, by exact score
    and then id.  The matrix product picks (with a margin above its rounding),
    a plain sum per pair decides, so a pair scores alike in every block."""
    products[qids[:, None] == ids[None, :]] = -np.inf
    m = min(n, products.shape[1])
    for i in range(len(qids)):
        row = products[i]
        cut = np.partition(row, len(row) - m)[len(row) - m]
        if not np.isfinite(cut):
            cut = np.finfo(float).min
        margin = 1e-9 * (1.0 + abs(cut)) if cut > np.finfo(float).min else 0.0
        at = np.flatnonzero((row >= cut - margin) & np.isfinite(row))
        score = (vectors[at] * queries[i]).sum(axis=1)
        order = np.lexsort((ids[at], -score))[:m]
        yield int(qids[i]), ids[at][order], score[order]


def nearest(
    table: DataFrame,
    is_query: Column,
    n: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    target: float = TARGET,
    tables: int = TABLES,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows where ``is_query``."""
    spark = table.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    good = table.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    widths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if widths is None:
        return spark.createDataFrame([], out_schema)
    d = widths["d"]
    good = good.where(F.size("v") == d)
    facts = good.agg(
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2"), F.count(F.lit(1)).alias("rows")
    ).first()
    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    index = fit_index(_matrix(sample["v"], d), float(np.sqrt(facts["norm2"])), n, facts["rows"], target, tables)
    shared = spark.sparkContext.broadcast(index)

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for b in batches:
            if not len(b):
                continue
            m = _matrix(b["v"], d)
            points = ix.rows(m)
            raw = [r.tobytes() for r in m]
            for t in range(tables):
                yield pd.DataFrame({"t": t, "key": ix.key(t, np.floor(ix.cells(t, points))), "id": b["id"], "raw": raw})

    def visit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        step = max(1, 200_000 // max(ix.visits, len(ix.moves) // 8, 1))
        for b in batches:
            for at in range(0, len(b), step):
                part = b.iloc[at : at + step]
                m = _matrix(part["v"], d)
                points = ix.queries(m)
                raw = np.array([r.tobytes() for r in m], dtype=object)
                for t in range(tables):
                    keys = ix.visited(t, points)
                    yield pd.DataFrame(
                        {"t": t, "key": keys.ravel(), "qid": np.repeat(part["id"].to_numpy(), keys.shape[1]), "qraw": np.repeat(raw, keys.shape[1])}
                    )

    # index: (table, bucket, block) -> rows of the block
    entries = cut_lineage(good.select("id", "v").mapInPandas(index_rows, "t int, key long, id long, raw binary"))
    sizes = entries.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = cut_lineage(
        entries.join(sizes, ["t", "key"])
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .groupBy("t", "key", "block")
        .agg(F.collect_list("id").alias("ids"), F.collect_list("raw").alias("raws"))
    )
    asked = good.where("asked").select("id", "v")
    visits = asked.mapInPandas(visit_rows, "t int, key long, qid long, qraw binary")
    # queries of a bucket in blocks too; buckets without a row drop out here
    visits = cut_lineage(visits.join(sizes.select("t", "key"), ["t", "key"], "left_semi"))
    asking = visits.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qblocks"))
    query_blocks = (
        visits.join(asking, ["t", "key"])
        .withColumn("qblock", F.pmod(F.xxhash64("qid"), F.col("qblocks")))
        .groupBy("t", "key", "qblock")
        .agg(F.collect_list("qid").alias("qids"), F.collect_list("qraw").alias("qraws"))
    )

    def rank_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pd.DataFrame:
            rows = pd.DataFrame(
                {
                    "query_id": np.repeat(np.fromiter(best, dtype=np.int64, count=len(best)), [len(i) for i, _ in best.values()]),
                    "vec_id": np.concatenate([i for i, _ in best.values()] or [np.zeros(0, np.int64)]).astype(np.int64),
                    "score": np.concatenate([s for _, s in best.values()] or [np.zeros(0)]),
                }
            )
            best.clear()
            return rows

        for b in batches:
            for ids, raws, qids, qraws in zip(b["ids"], b["raws"], b["qids"], b["qraws"]):
                ids, qids = np.asarray(ids), np.asarray(qids)
                v = np.frombuffer(b"".join(raws)).reshape(len(ids), d)
                q = np.frombuffer(b"".join(qraws)).reshape(len(qids), d)
                for qid, found, score in best_of(q @ v.T, q, v, qids, ids, n):
                    if qid in best:
                        had, had_score = best[qid]
                        if len(had) == n and len(score) and score[0] < had_score[-1]:
                            continue
                        found, first = np.unique(np.concatenate([had, found]), return_index=True)
                        score = np.concatenate([had_score, score])[first]
                        order = np.lexsort((found, -score))[:n]
                        found, score = found[order], score[order]
                    best[qid] = found, score
            if len(best) > _HELD:
                yield flush()
        yield flush()

    found_schema = "query_id long, vec_id long, score double"
    found = query_blocks.join(blocks, ["t", "key"]).select("ids", "raws", "qids", "qraws").mapInPandas(rank_blocks, found_schema)
    found = cut_lineage(found)
    enough = min(n, facts["rows"] - 1)
    got = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n_found"))
    short = cut_lineage(
        asked.join(got, asked["id"] == got["query_id"], "left").where(F.coalesce("n_found", F.lit(0)) < enough).select("id", "v")
    )
    if enough and short.limit(1).count():
        # these queries against all rows: every block of the first table
        to_raw = F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x, dtype=np.float64).tobytes()), "binary")
        n_blocks = -(-short.count() // QUERY_BLOCK)
        rest = (
            short.select("id", to_raw("v").alias("raw"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("qblock"))
            .groupBy("qblock")
            .agg(F.collect_list("id").alias("qids"), F.collect_list("raw").alias("qraws"))
        )
        more = blocks.where("t = 0").crossJoin(rest).select("ids", "raws", "qids", "qraws").mapInPandas(rank_blocks, found_schema)
        found = found.unionByName(more)
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # at most n rows a task and query come here, so a query's rows are few
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, n)
    ranked = merged.groupBy("query_id").agg(best.alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score")
    )


def nearest_query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 20 == 0)
