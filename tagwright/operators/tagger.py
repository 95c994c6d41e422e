"""Weak labels and tag prediction.

A fitted model is tiny - one row per tag with an intercept and one weight per
feature, plus the scaler's mean and scale - so it is collected once and baked
into column expressions: every score is ``b + sum(w_j * z_j)``, evaluated in
generated code with no join and no Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions.text import CLASSIFIER_FEATURES


@dataclass
class LinearTagModel:
    """One-vs-rest linear scorer over standardised features."""

    tags: list[str]
    weights: list[list[float]]  # per tag, one weight per feature
    intercepts: list[float]
    mean: list[float]
    scale: list[float]  # population std, 0 -> feature ignored (z = 0)
    features: list[str] = field(default_factory=lambda: list(CLASSIFIER_FEATURES))
    engine: str = "squared-hinge-newton"
    training_examples: int = 0
    support_vector_counts: dict[str, int] | None = None

    def z(self, j: int) -> Column:
        s = self.scale[j]
        if s == 0:
            return F.lit(0.0)
        return (F.col(self.features[j]).cast("double") - F.lit(self.mean[j])) / F.lit(s)

    def score_columns(self) -> list[Column]:
        zs = [self.z(j) for j in range(len(self.features))]
        out = []
        for t, w, b in zip(self.tags, self.weights, self.intercepts, strict=True):
            expr = F.lit(float(b))
            for wj, zj in zip(w, zs, strict=True):
                if wj != 0:
                    expr = expr + F.lit(float(wj)) * zj
            out.append(expr.alias(t))
        return out

    def scores(self) -> Column:
        """``array<struct<tag, score>>`` in class (sorted tag) order."""
        cols = self.score_columns()
        return F.array(*[F.struct(F.lit(t).alias("tag"), c.alias("score")) for t, c in zip(self.tags, cols, strict=True)])


def binarize_tags(df: DataFrame, tags_col: str, classes: Sequence[str]) -> DataFrame:
    """One 0/1 column per class (classes sorted; bounded by the tag
    vocabulary)."""
    return df.withColumns({f"y_{t}": F.array_contains(F.col(tags_col), F.lit(t)).cast("int") for t in classes})


def tag_classes(df: DataFrame, tags_col: str) -> list[str]:
    """The sorted tag vocabulary (one small aggregate)."""
    rows = df.select(F.explode(tags_col).alias("t")).distinct().collect()
    return sorted(r["t"] for r in rows)


def balanced_weights(df: DataFrame, tags_col: str, classes: Sequence[str]) -> DataFrame:
    """Per tag ``n / (2 * n_positive)`` and ``n / (2 * n_negative)`` in one
    aggregate over the training rows."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for t in classes:
        aggs.append(F.sum(F.array_contains(F.col(tags_col), F.lit(t)).cast("long")).alias(t))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{t}', `{t}`" for t in classes)
    long = wide.selectExpr("n", f"stack({len(classes)}, {stack}) as (tag, n_pos)")
    return long.select(
        "tag",
        "n",
        "n_pos",
        F.when(F.col("n_pos") > 0, F.col("n") / (2.0 * F.col("n_pos"))).alias("weight_pos"),
        F.when(F.col("n") - F.col("n_pos") > 0, F.col("n") / (2.0 * (F.col("n") - F.col("n_pos")))).alias("weight_neg"),
    )


def weak_labels(responses: DataFrame, tag_matrix: DataFrame, top_col: str = "top_cluster", sub_col: str = "cluster") -> DataFrame:
    """Every member of a subcluster receives all its tags.  The tag
    matrix is hand-written (one row per subcluster): broadcast after a size
    check, shuffle-joined otherwise."""
    from .profile import join_small

    tm = tag_matrix.select(F.col("top_cluster").alias(top_col), F.col("subcluster").alias(sub_col), "tags")
    return join_small(responses, tm, [top_col, sub_col], 256)


def rank_scores(scores: Column) -> Column:
    """Sort by score descending, ties by tag ascending."""
    keyed = F.transform(
        scores, lambda s: F.named_struct(F.lit("k"), -s["score"], F.lit("tag"), s["tag"], F.lit("score"), s["score"])
    )
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["tag"].alias("tag"), s["score"].alias("score")))


def predict_tags(ranked: Column, threshold: float, max_tags: int, allow_empty: bool = False) -> Column:
    """Tags with ``score >= threshold`` (inclusive), at most ``max_tags``;
    when none pass, the top tag (unless ``allow_empty``)."""
    passing = F.slice(F.filter(ranked, lambda s: s["score"] >= F.lit(threshold)), 1, max_tags)
    tags = F.transform(passing, lambda s: s["tag"])
    if allow_empty:
        return tags
    return F.when((F.size(tags) == 0) & (F.size(ranked) > 0), F.array(ranked[0]["tag"])).otherwise(tags)


def top_tags(ranked: Column, n: int = D.TOP_TAGS) -> Column:
    """The first ``n`` entries of the ranking."""
    return F.slice(ranked, 1, n)


def classify(
    df: DataFrame,
    scores: Column,
    threshold: float = D.DECISION_THRESHOLD,
    max_predicted_tags: int = D.MAX_PREDICTED_TAGS,
    n_top: int = D.TOP_TAGS,
    text_col: str | None = "assistant_output",
) -> DataFrame:
    """C6-C9 on every row: ranking, predicted tags, top tags and the
    180-character preview."""
    out = df.withColumn("__ranked", rank_scores(scores))
    cols = {
        "predicted_tags": predict_tags(F.col("__ranked"), threshold, max_predicted_tags),
        "top_tags": top_tags(F.col("__ranked"), n_top),
    }
    if text_col is not None:
        cols["response_preview"] = F.substring(F.col(text_col), 1, 180)
    return out.withColumns(cols).drop("__ranked")


def run_header(spark, model: LinearTagModel, threshold: float) -> DataFrame:
    """The one-row run header of a prediction file."""
    return spark.createDataFrame(
        [
            (
                "one_vs_rest_linear_svm",
                model.engine,
                int(model.training_examples),
                len(model.tags),
                float(threshold),
                model.support_vector_counts,
            )
        ],
        "algorithm string, svm_engine string, training_examples long, tag_count int, threshold double, "
        "support_vector_counts map<string,int>",
    )


def prediction_records(classified: DataFrame, key_cols: Sequence[str], features: Sequence[str] | None = None) -> DataFrame:
    """K8 record layout (D12): ``metadata`` map of the key columns,
    ``response_preview``, ``predicted_tags``, ``top_tags`` and, when given,
    ``feature_names`` / ``features``."""
    meta = F.create_map(*[x for k in key_cols for x in (F.lit(k), F.col(k).cast("string"))])
    cols = [meta.alias("metadata"), "response_preview", "predicted_tags", "top_tags"]
    if features:
        cols += [
            F.array(*[F.lit(f) for f in features]).alias("feature_names"),
            F.array(*[F.col(f).cast("double") for f in features]).alias("features"),
        ]
    return classified.select(*cols)
