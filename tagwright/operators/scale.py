"""Feature algebra (M1-M3): standardisation, weighted feature modes, PCA.

Statistics come from one aggregation over the data; only the per-column
means and deviations (or the d x d covariance for PCA) reach the driver, and
the transform is a plain column expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D


@dataclass
class Standardizer:
    """M1: mean 0 and *population* standard deviation 1; a constant column
    maps to 0 (Spark ML's StandardScaler uses the sample deviation, so it is
    not used)."""

    columns: list[str]
    mean: list[float]
    scale: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Standardizer:
        aggs = []
        for c in columns:
            aggs += [F.avg(F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double"))]
        row = df.agg(*aggs).first()
        mean = [float(row[2 * i] or 0.0) for i in range(len(columns))]
        scale = [float(row[2 * i + 1] or 0.0) for i in range(len(columns))]
        return cls(list(columns), mean, scale)

    def column(self, i: int, weight: float = 1.0) -> Column:
        c, m, s = self.columns[i], self.mean[i], self.scale[i]
        if s == 0:
            return F.lit(0.0)
        z = (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
        return z * F.lit(weight) if weight != 1.0 else z

    def transform(self, df: DataFrame, prefix: str = "z_", weight: float = 1.0) -> DataFrame:
        return df.withColumns({prefix + c: self.column(i, weight) for i, c in enumerate(self.columns)})


def vector_columns(df: DataFrame, vec_col: str, dims: int, prefix: str = "e") -> DataFrame:
    """Spread an ``array<float>`` column into ``dims`` double columns."""
    return df.withColumns({f"{prefix}{i}": F.col(vec_col)[i].cast("double") for i in range(dims)})


def feature_mode(
    df: DataFrame,
    mode: str,
    reduced_cols: Sequence[str],
    behavior_cols: Sequence[str],
    embedding_weight: float = D.EMBEDDING_WEIGHT,
    behavior_weight: float = D.BEHAVIOR_WEIGHT,
    out: str = "features",
) -> DataFrame:
    """M2: ``embeddings`` (reduced vectors as they are), ``behavior``
    (standardised behaviour features) or ``combined`` = [0.35 * z(reduced),
    2.0 * z(behaviour)], assembled into one ``array<double>`` column."""
    if mode == "embeddings":
        return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in reduced_cols]))
    b = Standardizer.fit(df, behavior_cols)
    if mode == "behavior":
        return df.withColumn(out, F.array(*[b.column(i) for i in range(len(behavior_cols))]))
    if mode != "combined":
        raise ValueError("feature mode must be embeddings, behavior or combined")
    e = Standardizer.fit(df, reduced_cols)
    return df.withColumn(
        out,
        F.array(
            *[e.column(i, embedding_weight) for i in range(len(reduced_cols))],
            *[b.column(i, behavior_weight) for i in range(len(behavior_cols))],
        ),
    )


@dataclass
class PCAModel:
    """M3: principal components of *centred* data.  Signs are fixed so that
    the largest-magnitude loading of each component is positive."""

    columns: list[str]
    mean: np.ndarray
    components: np.ndarray  # k x d
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray

    def project(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        cols = {}
        for k in range(self.components.shape[0]):
            expr = F.lit(0.0)
            for j, c in enumerate(self.columns):
                w = float(self.components[k, j])
                if w != 0.0:
                    expr = expr + F.lit(w) * (F.col(c).cast("double") - F.lit(float(self.mean[j])))
            cols[f"{prefix}{k}"] = expr
        return df.withColumns(cols)

    def inverse(self, coords: Sequence[Column]) -> list[Column]:
        """Map k coordinates back to the d input columns (for decision grids)."""
        out = []
        for j in range(self.components.shape[1]):
            expr = F.lit(float(self.mean[j]))
            for k, c in enumerate(coords):
                expr = expr + c * F.lit(float(self.components[k, j]))
            out.append(expr)
        return out


def fit_pca(df: DataFrame, columns: Sequence[str], k: int) -> PCAModel | None:
    """M3: PCA to ``min(k, n - 1, d)`` dimensions; ``None`` (skipped) when that
    is 0 or not below d.

    The covariance is accumulated by Spark ML (tree aggregation of a d x d
    Gram matrix) and decomposed on the driver; ML's ``transform`` does not
    centre, so :meth:`PCAModel.project` subtracts the mean itself.
    """
    from pyspark.ml.feature import PCA as MLPCA
    from pyspark.ml.functions import array_to_vector

    cols = list(columns)
    d = len(cols)
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    n = int(stats["n"])
    dims = min(k, n - 1, d)
    if dims <= 0 or dims >= d:
        return None
    mean = np.array([float(stats[c] or 0.0) for c in cols])
    vec = df.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])).alias("v"))
    model = MLPCA(k=dims, inputCol="v", outputCol="p").fit(vec)
    comps = model.pc.toArray().T.copy()  # k x d
    for r in range(dims):
        if comps[r, np.argmax(np.abs(comps[r]))] < 0:
            comps[r] = -comps[r]
    ratio = model.explainedVariance.toArray()
    return PCAModel(cols, mean, comps, ratio.copy(), ratio)
