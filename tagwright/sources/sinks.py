"""Writers (K1-K11).

Data-sized outputs are written in parallel (parquet / JSON lines / CSV part
files).  Reports that are bounded by the number of clusters, tags or grid
settings (cluster Markdown, manifests, sweep tables) are coalesced to one
part so they read as one document.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sweep import CSV_COLUMNS


def write_splits(df: DataFrame, path: str, split_col: str = "source_split") -> DataFrame:
    """K1: one folder per split (``partitionBy``), returning rows per split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)
    return df.groupBy(split_col).count()


def write_parquet(df: DataFrame, path: str) -> None:
    """K2 / K3 / K4: responses, vectors and cluster labels live in one table
    (the vector is an array column, never a separate positional file)."""
    df.write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """K5 / K8 / K9: JSON lines, one record per row."""
    df.write.mode("overwrite").json(path)


def write_manifest(spark: SparkSession, facts: dict, path: str) -> None:
    """K7: a run manifest (facts computed by aggregations) as one JSON
    document."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


@F.pandas_udf(T.StringType())
def _py_fixed2(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None or x != x else f"{x:.2f}")


@F.pandas_udf(T.StringType())
def _py_fixed1(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None or x != x else f"{x:.1f}")


def write_evaluation(parts: dict[str, DataFrame], path: str) -> None:
    """K9: the evaluation as one JSON-lines table per part (overall, per_tag,
    primary_confusion, confusion_pairs, ...) under ``path/<part>``.  Every
    part is bounded by the tag vocabulary (or is a single row), so each is
    written as one file."""
    for name, df in parts.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def pct(c) -> F.Column:
    """``{:.2%}`` formatting with Python's rounding (half-even on the exact
    binary value; Java's ``%.2f`` rounds the shortest decimal half-up).  Used
    on report rows only - one row per cluster - so a pandas UDF is fine."""
    return F.concat(_py_fixed2(c * 100), F.lit("%"))


def fixed1(c) -> F.Column:
    return _py_fixed1(c)


def cluster_report_lines(summary: DataFrame, terms: DataFrame, samples: DataFrame) -> DataFrame:
    """K6: the Markdown cluster report as ``(cluster, line_no, line)`` rows.

    ``summary`` holds the A1-A3 columns, ``terms`` ``(cluster, rank, term)``
    and ``samples`` ``(cluster, rank, assistant_output)``.  All three are
    bounded by clusters x (top terms + samples).
    """
    term_list = terms.groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ", ").alias(
            "terms"
        )
    )
    s = summary.join(term_list, "cluster", "left")
    label = F.when(F.col("is_noise"), F.lit("Noise")).otherwise(F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    head = F.array(
        F.concat(F.lit("## "), label),
        F.lit(""),
        F.concat(F.lit("- Members: "), F.col("members").cast("string")),
        F.concat(F.lit("- Fraction: "), pct(F.col("fraction"))),
        F.concat(F.lit("- Avg words: "), fixed1(F.col("avg_words"))),
        F.concat(F.lit("- List format: "), pct(F.col("list_format_fraction"))),
        F.concat(F.lit("- Code blocks: "), pct(F.col("code_block_fraction"))),
        F.concat(F.lit("- Refusal markers: "), pct(F.col("refusal_marker_fraction"))),
        F.concat(F.lit("- Politeness markers: "), pct(F.col("politeness_marker_fraction"))),
        F.concat(F.lit("- Agree-to-help openings: "), pct(F.col("assist_agreement_opening_fraction"))),
        F.concat(F.lit("- Agree-to-inform openings: "), pct(F.col("information_agreement_opening_fraction"))),
        F.concat(F.lit("- Agree-with-user openings: "), pct(F.col("user_validation_opening_fraction"))),
        F.concat(F.lit("- Clarification/uncertainty: "), pct(F.col("clarification_or_uncertainty_fraction"))),
        F.concat(F.lit("- Top terms: "), F.coalesce(F.col("terms"), F.lit(""))),
        F.lit(""),
    )
    head_rows = s.select("cluster", F.posexplode(head).alias("line_no", "line"))
    sample_rows = samples.select(
        "cluster",
        F.posexplode(
            F.array(
                F.concat(
                    F.lit("Sample "), F.col("rank").cast("string"), F.lit(": "), F.replace(F.col("assistant_output"), F.lit("\n"), F.lit(" "))
                ),
                F.lit(""),
            )
        ).alias("k", "line"),
        "rank",
    ).select("cluster", (F.lit(100) + F.col("rank") * 2 + F.col("k")).alias("line_no"), "line")
    return head_rows.unionByName(sample_rows)


def write_cluster_report(lines: DataFrame, path: str) -> None:
    """K6: ``# Cluster Summary`` then each cluster's block, clusters in id
    order (the report is bounded by clusters, so one part file)."""
    spark = lines.sparkSession
    title = spark.createDataFrame([(-(2**31), 0, "# Cluster Summary"), (-(2**31), 1, "")], "cluster int, line_no int, line string")
    everything = title.unionByName(lines.select(F.col("cluster").cast("int"), F.col("line_no").cast("int"), "line"))
    (
        everything.coalesce(1)
        .sortWithinPartitions("cluster", "line_no")
        .select("line")
        .write.mode("overwrite")
        .text(path)
    )


def write_disagreements(rows: DataFrame, path: str) -> None:
    """The disagreement rows as CSV with the 8 fixed columns."""
    cols = ["id", "source_row", "response_index", "true_tags", "predicted_tags", "missing_tags", "extra_tags", "assistant_preview"]
    rows.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_sweep(results: DataFrame, path_csv: str, path_json: str | None = None, extra: Sequence[str] = ()) -> None:
    """The sweep table in ranked order (60 rows by default)."""
    ordered = results.orderBy("rank").coalesce(1)
    ordered.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path_csv)
    if path_json:
        ordered.select("rank", *CSV_COLUMNS, *extra).write.mode("overwrite").json(path_json)
