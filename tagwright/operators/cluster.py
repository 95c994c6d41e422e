"""Clustering (M5, M6, M8, M9).

* M5 - Spark ML ``KMeans`` (k-means|| start, seeded); label ids are arbitrary.
* M6 - assignment to the nearest of given centroids plus one Lloyd update,
  the deterministic core of k-means.  Centroids are bounded (k x d), so they
  are literals inside the expression - no join, no Python.
* M9 - sub-clustering of *every* parent in the same DataFrame rounds: the
  centroid table is keyed by (parent, sub), each round assigns every row to
  the nearest centroid of its own parent and averages per (parent, sub).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..session import cut_lineage, release
from .profile import BROADCAST_LIMIT_BYTES, centroids
from .split import cap_per_group


def to_vector(col: str | Column):
    from pyspark.ml.functions import array_to_vector

    c = F.col(col) if isinstance(col, str) else col
    return array_to_vector(c.cast("array<double>"))


def kmeans(df: DataFrame, vec_col: str, k: int = D.KMEANS_CLUSTERS, seed: int = D.SEED, max_iter: int = 20) -> tuple[DataFrame, dict]:
    """M5: labels in ``cluster`` and the run facts (M8).  Spark ML stops when no
    centre moves any more or after ``max_iter`` rounds; ``rounds`` and
    ``converged`` (fewer rounds than that) tell which."""
    from pyspark.ml.clustering import KMeans

    data = df.withColumn("__v", to_vector(vec_col))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__v", predictionCol="cluster", initMode="k-means||").fit(data)
    out = model.transform(data).drop("__v")
    facts = {
        "algorithm": "kmeans",
        "kmeans_clusters": k,
        "cluster_count": out.select("cluster").distinct().count(),
        "noise_count": 0,
        "noise_fraction": 0.0,
        "inertia": float(model.summary.trainingCost),
        "rounds": model.summary.numIter,
        "converged": model.summary.numIter < max_iter,
    }
    return out, facts


def sq_distance(vec: Column, center: Sequence[float]) -> Column:
    """Squared Euclidean distance to a literal centre."""
    cen = F.array(*[F.lit(float(x)) for x in center])
    return F.aggregate(
        F.zip_with(vec, cen, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda acc, v: acc + v
    )


def assign_nearest(df: DataFrame, vec_col: str, centers: dict[int, Sequence[float]], out: str = "assigned", digits: int = 9) -> DataFrame:
    """M6 (assignment): nearest centre by Euclidean distance rounded to
    ``digits`` places, ties to the lowest centre id."""
    cands = F.array(
        *[
            F.struct(F.round(F.sqrt(sq_distance(F.col(vec_col), c)), digits).alias("d"), F.lit(int(i)).alias("c"))
            for i, c in sorted(centers.items())
        ]
    )
    best = F.array_min(cands)
    return df.withColumn(out, best["c"]).withColumn(f"{out}_distance", best["d"])


def lloyd_step(df: DataFrame, vec_col: str, centers: dict[int, Sequence[float]]) -> tuple[DataFrame, DataFrame]:
    """M6: one assignment and the updated centroids ``(cluster, centroid)``."""
    assigned = assign_nearest(df, vec_col, centers, out="cluster")
    return assigned, centroids(assigned, vec_col, "cluster")


def inertia(assigned: DataFrame, distance_col: str = "cluster_distance") -> float:
    """M8: sum of squared distances to the assigned centres."""
    return float(assigned.agg(F.sum(F.col(distance_col) * F.col(distance_col))).first()[0] or 0.0)


def run_facts(labelled: DataFrame, cluster_col: str = "cluster", extra: Sequence[Column] = ()) -> DataFrame:
    """M8: cluster count (noise excluded), noise count and fraction (plus any
    ``extra`` aggregates, e.g. inertia) - one aggregation."""
    c = F.col(cluster_col)
    return labelled.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.when(c != -1, c)).alias("cluster_count"),
        F.sum((c == -1).cast("long")).alias("noise_count"),
        *extra,
    ).withColumn("noise_fraction", F.col("noise_count") / F.col("rows"))


def grouped_kmeans(
    df: DataFrame,
    parent_col: str,
    key_col: str,
    vec_col: str,
    k: int,
    iterations: int = 10,
    seed: int = D.SEED,
) -> DataFrame:
    """M9: k-means inside every parent cluster at once.

    Start: the first ``k`` members of each parent in hash order (exact,
    skew-safe via :func:`cap_per_group`).  Each round joins the centroid table
    (parents x k x d numbers; broadcast when small, shuffled otherwise) to the
    rows by parent, assigns the nearest centroid and averages per (parent,
    sub).  Lineage is cut every few rounds.
    """
    seeds = cap_per_group(df.select(parent_col, key_col, vec_col), [parent_col], key_col, k, seed)
    from pyspark.sql import Window

    seeds = seeds.withColumn(
        "sub", F.row_number().over(Window.partitionBy(parent_col).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string"))), key_col)) - 1
    )
    cents = seeds.select(parent_col, "sub", F.col(vec_col).cast("array<double>").alias("centroid"))
    dims = max(1, len(df.select(vec_col).first()[0]))
    last_cut = None
    for it in range(iterations):
        table = cents.groupBy(parent_col).agg(F.collect_list(F.struct("sub", "centroid")).alias("__cs"))
        n = table.count()
        est = n * k * 8 * dims
        table = F.broadcast(table) if est <= BROADCAST_LIMIT_BYTES else table
        assigned = df.join(table, parent_col).withColumn(
            "__best",
            F.array_min(
                F.transform(
                    "__cs",
                    lambda s: F.named_struct(
                        F.lit("d"),
                        F.round(
                            F.aggregate(
                                F.zip_with(F.col(vec_col), s["centroid"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                                F.lit(0.0),
                                lambda acc, v: acc + v,
                            ),
                            9,
                        ),
                        F.lit("sub"),
                        s["sub"],
                    ),
                )
            ),
        ).select(*df.columns, F.col("__best.sub").alias("subcluster"), F.col("__best.d").alias("__d2"))
        if it == iterations - 1:
            return assigned.drop("__d2")
        parts = assigned.select(parent_col, "subcluster", F.posexplode(F.col(vec_col)).alias("__i", "__v"))
        cents = (
            parts.groupBy(parent_col, "subcluster", "__i")
            .agg(F.avg(F.col("__v").cast("double")).alias("__m"))
            .groupBy(parent_col, F.col("subcluster").alias("sub"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("centroid"))
        )
        if it % 3 == 2:
            cents = cut_lineage(cents)
            release(last_cut)
            last_cut = cents
    return df.withColumn("subcluster", F.lit(None).cast("int"))
