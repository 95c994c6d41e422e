"""Cluster profiling (A1-A8): sizes, text statistics, marker fractions, top
terms and representative responses per cluster.

All statistics are partial aggregations keyed by cluster, so a cluster that
holds a third of the rows is combined map-side before any shuffle.  Windows
only run on already aggregated rows or through the salted top-k helper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regex as rx
from ..functions.text import (
    char_count,
    code_fence_flag,
    list_format_flag,
    phrase_flag,
    term_tokens,
    word_count,
)
from .. import defaults as D
from ..session import cut_lineage
from .responses import sample_text
from .quantile import grouped_medians
from .topk import top_k_per_group

MARKER_FRACTIONS = [
    "list_format_fraction",
    "code_block_fraction",
    "refusal_marker_fraction",
    "politeness_marker_fraction",
    "assist_agreement_opening_fraction",
    "information_agreement_opening_fraction",
    "user_validation_opening_fraction",
    "clarification_or_uncertainty_fraction",
]

# Above this many bytes a centroid table is joined by shuffle, not broadcast.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def _marker_flags(t: Column) -> list[Column]:
    return [
        list_format_flag(t),
        code_fence_flag(t),
        phrase_flag(t, rx.REFUSAL),
        phrase_flag(t, rx.POLITENESS_CLUSTER),
        phrase_flag(t, rx.ASSIST_OPENING, True),
        phrase_flag(t, rx.INFORMATION_OPENING, True),
        phrase_flag(t, rx.VALIDATION_OPENING, True),
        phrase_flag(t, rx.CLARIFICATION),
    ]


def with_share(agg: DataFrame, count_col: str = "members", out: str = "fraction") -> DataFrame:
    """Share of the total; the window runs over the aggregated rows only."""
    return agg.withColumn(out, F.col(count_col) / F.sum(count_col).over(Window.partitionBy()))


def cluster_sizes(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """A1: members, fraction of all rows and the noise flag per cluster."""
    agg = df.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("members"))
    return with_share(agg).withColumn("is_noise", F.col("cluster") == -1)


def cluster_profile(
    df: DataFrame,
    cluster_col: str = "cluster",
    text: str = "assistant_output",
    approx_median: bool = False,
) -> DataFrame:
    """A1-A3: sizes, mean and median of characters and words (words *not*
    floored) and the eight marker fractions.

    The exact medians come from the counts of each cluster's different values
    (``grouped_medians``), so no cluster's rows meet in one task.
    ``approx_median`` switches to ``percentile_approx`` for very wide value
    ranges.
    """
    t = F.col(text).cast("string")
    flags = _marker_flags(t)
    pre = df.select(
        F.col(cluster_col).alias("cluster"),
        char_count(t).alias("__chars"),
        word_count(t).alias("__words"),
        *[f.alias(f"__f{i}") for i, f in enumerate(flags)],
    )
    means = [F.count(F.lit(1)).alias("members"), F.avg("__chars").alias("avg_chars"), F.avg("__words").alias("avg_words")]
    fractions = [F.avg(f"__f{i}").alias(name) for i, name in enumerate(MARKER_FRACTIONS)]
    if approx_median:
        medians = [F.percentile_approx(f"__{c}", 0.5, 10000).cast("double").alias(f"median_{c}") for c in ("chars", "words")]
        agg = pre.groupBy("cluster").agg(*means, *medians, *fractions)
    else:
        exact = grouped_medians(pre.withColumns({f"median_{c}": F.col(f"__{c}") for c in ("chars", "words")}), "cluster", ["median_chars", "median_words"])
        both = exact.withColumnRenamed("cluster", "__c")
        agg = pre.groupBy("cluster").agg(*means, *fractions)
        agg = agg.join(both, agg["cluster"].eqNullSafe(both["__c"])).drop("__c")
    names = ["members", "avg_chars", "median_chars", "avg_words", "median_words", *MARKER_FRACTIONS]
    agg = agg.select("cluster", *names)
    return with_share(agg).withColumn("is_noise", F.col("cluster") == -1)


def top_terms(
    df: DataFrame,
    order_cols: Sequence[str],
    cluster_col: str = "cluster",
    text: str = "assistant_output",
    limit: int = D.TOP_TERMS,
) -> DataFrame:
    """A4: the ``limit`` most frequent term tokens per cluster; ties go to the
    term met first in row order (``order_cols``) and token position."""
    toks = df.select(F.col(cluster_col).alias("cluster"), F.explode(term_tokens(F.col(text))).alias("term"))
    counts = toks.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("count"))
    # counts alone stay in a hash table; only terms that can still be listed are looked up in row order
    counts = cut_lineage(counts)
    best = top_k_per_group(counts, ["cluster"], [F.desc("count"), F.asc("term")], limit, salt_cols=["term"])
    least = best.groupBy(F.col("cluster").alias("__c")).agg(F.min("count").alias("__least"))
    listed = counts.join(least, F.col("cluster").eqNullSafe(F.col("__c"))).where(F.col("count") >= F.col("__least"))
    listed = cut_lineage(listed.select(F.col("cluster").alias("__c"), F.col("term").alias("__t"), "count"))
    places = df.select(
        F.col(cluster_col).alias("cluster"), *order_cols, F.posexplode(term_tokens(F.col(text))).alias("__pos", "term")
    )
    same = F.col("cluster").eqNullSafe(F.col("__c")) & (F.col("term") == F.col("__t"))
    first = F.struct(*[F.col(c) for c in order_cols], F.col("__pos"))
    firsts = join_small(places, listed, same, width_bytes=64).groupBy("cluster", "term", "count").agg(F.min(first).alias("__first"))
    ranked = top_k_per_group(firsts, ["cluster"], [F.desc("count"), F.asc("__first")], limit, salt_cols=["term"])
    return ranked.select("cluster", "rank", "term", "count")


def centroids(df: DataFrame, vec_col: str, cluster_col: str = "cluster") -> DataFrame:
    """Per-cluster mean vector as ``array<double>`` (one partial aggregation
    per (cluster, dimension))."""
    parts = df.select(F.col(cluster_col).alias("cluster"), F.posexplode(F.col(vec_col)).alias("__i", "__v"))
    per_dim = parts.groupBy("cluster", "__i").agg(F.avg(F.col("__v").cast("double")).alias("__m"))
    return per_dim.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("centroid")
    )


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, v: acc + v)
    )


def join_small(df: DataFrame, small: DataFrame, on, width_bytes: int, how: str = "inner") -> DataFrame:
    """Join ``small`` (bounded by clusters, tags or grid cells) by broadcast
    only when its measured size is under :data:`BROADCAST_LIMIT_BYTES`;
    otherwise a shuffle join."""
    n = small.count()
    if n * max(width_bytes, 1) <= BROADCAST_LIMIT_BYTES:
        return df.join(F.broadcast(small), on, how)
    return df.join(small, on, how)


def representatives(
    df: DataFrame,
    vec_col: str,
    key_cols: Sequence[str],
    cluster_col: str = "cluster",
    limit: int = D.SAMPLES_PER_CLUSTER,
    dims_hint: int = 64,
) -> DataFrame:
    """A5: per cluster, all members in key order when there are at most
    ``limit``; otherwise the ``limit`` members nearest to the centroid
    (Euclidean, distances rounded to 9 places, ties by key)."""
    cents = centroids(df, vec_col, cluster_col)
    sizes = df.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("__members"))
    small = cents.join(sizes, "cluster")
    base = df.withColumnRenamed(cluster_col, "cluster") if cluster_col != "cluster" else df
    joined = join_small(base, small, "cluster", width_bytes=8 * dims_hint + 64)
    dist = F.round(euclidean(F.col(vec_col), F.col("centroid")), 9)
    ordered = joined.withColumn("distance", dist).withColumn(
        "__o", F.when(F.col("__members") <= limit, F.lit(0.0)).otherwise(F.col("distance"))
    )
    ranked = top_k_per_group(
        ordered, ["cluster"], [F.asc("__o"), *[F.asc(c) for c in key_cols]], limit, salt_cols=list(key_cols)
    )
    return ranked.drop("__o", "__members", "centroid")


def sample_records(reps: DataFrame, sample_chars: int = D.SAMPLE_CHARS) -> DataFrame:
    """The representatives as an ordered ``samples`` array per cluster
    (at most ``limit`` entries each, so the collect is bounded)."""
    rec = F.struct(
        F.col("rank"),
        F.col("source_split"),
        F.col("source_row").cast("long").alias("source_row"),
        F.col("response_index").cast("long").alias("response_index"),
        F.col("prompt_id"),
        sample_text("assistant_output", sample_chars).alias("assistant_output"),
    )
    return reps.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(rec)), lambda s: s.dropFields("rank")).alias("samples")
    )


def size_pivot(sub_sizes: DataFrame, sub_values: Sequence) -> DataFrame:
    """Parent x subcluster member counts, missing cells 0."""
    return (
        sub_sizes.groupBy("top_cluster")
        .pivot("subcluster", list(sub_values))
        .agg(F.sum("members"))
        .fillna(0)
    )


def sizes_desc(sub_sizes: DataFrame) -> DataFrame:
    """Subcluster sizes by members, descending (label breaks ties)."""
    return sub_sizes.orderBy(F.desc("members"), F.asc("top_cluster"), F.asc("subcluster"))
