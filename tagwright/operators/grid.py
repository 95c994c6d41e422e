"""Data behind the figures (G1-G8): 2-D projection, hexagonal density bins,
dominant cluster per grid cell, cell opacity, cluster centres in 2-D, scatter
samples and the classifier's decision grid.

Binning is arithmetic on each row followed by one ``groupBy`` over cells;
per-axis bounds are exact percentiles.  The decision grid
is generated with ``spark.range`` and scored with the model's literal
weights.  Drawing is out of scope.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantile import exact_percentiles
from .scale import PCAModel, fit_pca
from .tagger import LinearTagModel


def projection_2d(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, PCAModel | None]:
    """G1: pass two columns through as ``(x, y)``; otherwise PCA to 2."""
    cols = list(columns)
    if len(cols) == 2:
        return df.withColumn("x", F.col(cols[0]).cast("double")).withColumn("y", F.col(cols[1]).cast("double")), None
    model = fit_pca(df, cols, 2)
    if model is None:
        raise ValueError("cannot project to 2 dimensions")
    out = model.project(df, prefix="__pc")
    return out.withColumnRenamed("__pc0", "x").withColumnRenamed("__pc1", "y"), model


def hexbin_counts(df: DataFrame, gridsize: int = 70) -> DataFrame:
    """Hexagonal bins over the data extent (two offset lattices, the
    nearer centre wins), empty bins left out, ``log10`` of the count."""
    nx = gridsize
    ny = int(nx / math.sqrt(3))
    b = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    x0, x1, y0, y1 = b["x0"], b["x1"], b["y0"], b["y1"]
    px, py = 1e-9 * (x1 - x0), 1e-9 * (y1 - y0)
    x0, x1, y0, y1 = x0 - px, x1 + px, y0 - py, y1 + py
    sx, sy = (x1 - x0) / nx, (y1 - y0) / ny
    ix = (F.col("x") - F.lit(x0)) / F.lit(sx)
    iy = (F.col("y") - F.lit(y0)) / F.lit(sy)
    ix1, iy1 = F.bround(ix, 0), F.bround(iy, 0)
    ix2, iy2 = F.floor(ix), F.floor(iy)
    d1 = (ix - ix1) * (ix - ix1) + 3.0 * (iy - iy1) * (iy - iy1)
    d2 = (ix - ix2 - 0.5) * (ix - ix2 - 0.5) + 3.0 * (iy - iy2 - 0.5) * (iy - iy2 - 0.5)
    first = d1 < d2
    cells = df.select(
        F.when(first, 1).otherwise(2).alias("lattice"),
        F.when(first, ix1).otherwise(ix2).cast("long").alias("i"),
        F.when(first, iy1).otherwise(iy2).cast("long").alias("j"),
    )
    return cells.groupBy("lattice", "i", "j").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "log_count", F.log10(F.col("count").cast("double"))
    )


def percentile_box(df: DataFrame, lo: float, hi: float) -> tuple[float, float, float, float]:
    """Exact (linear) percentiles of x and y: low and high x, low and high y."""
    return tuple(exact_percentiles(df, [(c, q / 100.0) for c in ("x", "y") for q in (lo, hi)]))


def dominant_cells(df: DataFrame, cluster_col: str = "cluster", edges: int = 95) -> DataFrame:
    """G3 + G4: cells between the 1st and 99th percentile of each axis
    (``edges - 1`` half-open cells per axis, points outside dropped); per cell
    the cluster with most points (ties to the lowest id), the density and the
    opacity ``clip(log1p(d) / log1p(max d), 0.18, 0.82)``."""
    xl, xh, yl, yh = percentile_box(df, 1, 99)
    n = edges - 1
    sx, sy = (xh - xl) / n, (yh - yl) / n
    cx = F.floor((F.col("x") - F.lit(xl)) / F.lit(sx)) if sx > 0 else F.lit(None)
    cy = F.floor((F.col("y") - F.lit(yl)) / F.lit(sy)) if sy > 0 else F.lit(None)
    cells = df.select(cx.cast("long").alias("cx"), cy.cast("long").alias("cy"), F.col(cluster_col).alias("cluster"))
    cells = cells.where((F.col("cx") >= 0) & (F.col("cx") < n) & (F.col("cy") >= 0) & (F.col("cy") < n))
    per = cells.groupBy("cx", "cy", "cluster").agg(F.count(F.lit(1)).alias("n"))
    # windows over the aggregated cells only (at most (edges-1)^2 x clusters rows)
    cell = Window.partitionBy("cx", "cy")
    ranked = per.withColumn("__r", F.row_number().over(cell.orderBy(F.desc("n"), F.asc("cluster")))).withColumn(
        "density", F.sum("n").over(cell)
    )
    dom = ranked.where("__r = 1").select("cx", "cy", F.col("cluster").alias("dominant_cluster"), "density")
    mx = F.max("density").over(Window.partitionBy())
    alpha = F.least(F.greatest(F.log1p("density") / F.log1p(mx), F.lit(0.18)), F.lit(0.82))
    return dom.withColumn("alpha", alpha)


def centers_2d(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Mean position and name of every cluster ("noise" for -1)."""
    c = F.col(cluster_col)
    return df.groupBy(c.alias("cluster")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn(
        "name", F.when(F.col("cluster") == -1, F.lit("noise")).otherwise(F.concat(F.lit("cluster "), F.col("cluster").cast("string")))
    )


def decision_grid(
    spark: SparkSession,
    box: tuple[float, float, float, float],
    inverse: Sequence[Column] | None,
    model: LinearTagModel,
    size: int = 220,
) -> DataFrame:
    """A ``size`` x ``size`` grid over the 5-95 percentile box padded by
    max(12 %, 0.5); each grid point is mapped back to the (scaled) feature
    space by ``inverse`` (columns over ``gx``/``gy``), scored for every tag,
    and the winning tag (first on ties) is kept."""
    xl, xh, yl, yh = box
    xp, yp = max((xh - xl) * 0.12, 0.5), max((yh - yl) * 0.12, 0.5)
    a, b = xl - xp, xh + xp
    c, d = yl - yp, yh + yp
    g = spark.range(size * size).select(
        (F.col("id") % size).cast("int").alias("ix"), (F.col("id") / size).cast("int").alias("iy")
    )
    step_x, step_y = (b - a) / (size - 1), (d - c) / (size - 1)
    gx = F.when(F.col("ix") == size - 1, F.lit(b)).otherwise(F.lit(a) + F.col("ix") * F.lit(step_x))
    gy = F.when(F.col("iy") == size - 1, F.lit(d)).otherwise(F.lit(c) + F.col("iy") * F.lit(step_y))
    g = g.withColumns({"gx": gx, "gy": gy})
    feats = inverse if inverse is not None else [F.col("gx"), F.col("gy")]
    g = g.withColumns({model.features[j]: feats[j] for j in range(len(model.features))})
    # the grid lives in the scaled space already: identity scaler
    scaled = LinearTagModel(
        model.tags, model.weights, model.intercepts, [0.0] * len(model.features), [1.0] * len(model.features), model.features
    )
    scores = scaled.score_columns()
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-k).alias("k")) for k, s in enumerate(scores)]))
    tags = F.array(*[F.lit(t) for t in model.tags])
    return g.select(
        "ix", "iy", "gx", "gy", *[s.alias(f"score_{t}") for s, t in zip(scores, model.tags, strict=True)],
        F.element_at(tags, (-best["k"] + 1).cast("int")).alias("winning_tag"),
    )


def mark_positives(sample: DataFrame, tags_col: str, tag: str) -> DataFrame:
    """Flag the sampled training rows that carry ``tag``."""
    return sample.withColumn("positive", F.array_contains(F.col(tags_col), F.lit(tag)))
