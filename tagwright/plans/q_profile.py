"""Cluster-profile queries (A1-A8) over the clustered-responses relation
(``embeddings.label`` as cluster, ``documents.text`` as response)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as pf
from ..session import read_table
from . import derived as dv
from . import sqltext as sq
from .q_text import _profile_sql, _round_profile
from .registry import r6, register, s6

CR = f"cr AS ({dv.CLUSTERED_RESPONSES_SQL})"
KEYS = ["source_split", "source_row", "response_index"]
LANGS = ["de", "en", "es", "fr"]


@register(
    "a1_cluster_sizes",
    f"WITH {CR} SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS members, "
    f"{s6('count(*) / sum(count(*)) OVER ()')} AS fraction, cluster = -1 AS is_noise FROM cr GROUP BY cluster",
)
def q_a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pf.cluster_sizes(dv.clustered_responses(spark, sf_dir))
    return s.select("cluster", "members", r6("fraction").alias("fraction"), "is_noise")


@register("a1_a3_cluster_profile", f"WITH {CR} " + _profile_sql("cr", "cluster"))
def q_a1_a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_profile(pf.cluster_profile(dv.clustered_responses(spark, sf_dir)))


@register(
    "a4_top_terms",
    f"""WITH {CR},
    tk AS (SELECT cluster, source_split, source_row, response_index, {sq.term_tokens('assistant_output')} AS toks FROM cr),
    toks AS (SELECT cluster, source_split, source_row, response_index, unnest(toks) AS term,
                    unnest(generate_series(0, len(toks) - 1)) AS pos FROM tk),
    counts AS (SELECT cluster, term, count(*) AS count,
                      min({{'a': source_split, 'b': source_row, 'c': response_index, 'd': pos}}) AS first
               FROM toks GROUP BY cluster, term),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, first) AS rank FROM counts)
    SELECT CAST(cluster AS INTEGER) AS cluster, CAST(rank AS INTEGER) AS rank, term, count FROM ranked WHERE rank <= 10""",
)
def q_a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pf.top_terms(dv.clustered_responses(spark, sf_dir), KEYS, limit=10)
    return t.select(F.col("cluster").cast("int"), F.col("rank").cast("int"), "term", "count")


REPS_SQL = f"""WITH {CR},
    dims AS (SELECT cluster, source_split, source_row, response_index, unnest(embedding) AS v,
                    unnest(generate_series(1, len(embedding))) AS i FROM cr),
    cent AS (SELECT cluster, i, avg(CAST(v AS DOUBLE)) AS m FROM dims GROUP BY cluster, i),
    dist AS (SELECT d.cluster, d.source_split, d.source_row, d.response_index,
                    round(sqrt(sum((CAST(d.v AS DOUBLE) - c.m) * (CAST(d.v AS DOUBLE) - c.m))), 9) AS distance
             FROM dims d JOIN cent c ON d.cluster = c.cluster AND d.i = c.i
             GROUP BY d.cluster, d.source_split, d.source_row, d.response_index),
    sz AS (SELECT cluster, count(*) AS members FROM cr GROUP BY cluster),
    ranked AS (SELECT dist.*, row_number() OVER (PARTITION BY dist.cluster ORDER BY
                      CASE WHEN members <= 5 THEN 0.0 ELSE distance END, source_split, source_row, response_index) AS rank
               FROM dist JOIN sz ON dist.cluster = sz.cluster)"""


@register(
    "a5_representatives",
    REPS_SQL
    + " SELECT CAST(cluster AS INTEGER) AS cluster, CAST(rank AS INTEGER) AS rank, source_row, "
    "round(distance, 6) AS distance FROM ranked WHERE rank <= 5",
)
def q_a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = pf.representatives(dv.clustered_responses(spark, sf_dir), "embedding", KEYS, limit=5)
    return reps.select(
        F.col("cluster").cast("int"), F.col("rank").cast("int"), "source_row", r6("distance").alias("distance")
    )


def _sample_sql(t: str, n: int = 1200) -> str:
    cut = f"regexp_replace(substr({t}, 1, {n}), '{sq.WS}+$', '')"
    return f"CASE WHEN length({t}) > {n} THEN {cut} || '...' ELSE {t} END"


@register(
    "a6_sample_records",
    REPS_SQL
    + f""", picked AS (SELECT r.cluster, r.rank, cr.prompt_id, {_sample_sql('cr.assistant_output')} AS sample
            FROM ranked r JOIN cr ON r.cluster = cr.cluster AND r.source_row = cr.source_row WHERE r.rank <= 5)
    SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS samples,
           string_agg(prompt_id, ',' ORDER BY rank) AS sample_ids,
           CAST(sum(length(sample)) AS BIGINT) AS sample_chars,
           md5(string_agg(sample, '|' ORDER BY rank)) AS sample_digest
    FROM picked GROUP BY cluster""",
)
def q_a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = pf.representatives(dv.clustered_responses(spark, sf_dir), "embedding", KEYS, limit=5)
    recs = pf.sample_records(reps)
    return recs.select(
        F.col("cluster").cast("int").alias("cluster"),
        F.size("samples").cast("long").alias("samples"),
        F.array_join(F.transform("samples", lambda s: s["prompt_id"]), ",").alias("sample_ids"),
        F.aggregate(
            F.transform("samples", lambda s: F.length(s["assistant_output"]).cast("long")), F.lit(0).cast("long"),
            lambda a, b: a + b,
        ).alias("sample_chars"),
        F.md5(F.array_join(F.transform("samples", lambda s: s["assistant_output"]), "|")).alias("sample_digest"),
    )


def _sub_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent cluster x language as the two-level size table."""
    emb = read_table(spark, sf_dir, "embeddings")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return (
        emb.join(docs, emb.vec_id == docs.doc_id)
        .groupBy(F.col("label").alias("top_cluster"), F.col("lang").alias("subcluster"))
        .agg(F.count(F.lit(1)).alias("members"))
    )


SUB_SQL = (
    "sub AS (SELECT e.label AS top_cluster, d.lang AS subcluster, count(*) AS members "
    "FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id GROUP BY 1, 2)"
)


@register(
    "a7_size_pivot",
    f"WITH {SUB_SQL} SELECT CAST(top_cluster AS INTEGER) AS top_cluster, "
    + ", ".join(f"CAST(coalesce(sum(members) FILTER (WHERE subcluster = '{v}'), 0) AS BIGINT) AS {v}" for v in LANGS)
    + " FROM sub GROUP BY top_cluster",
)
def q_a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pf.size_pivot(_sub_sizes(spark, sf_dir), LANGS)
    return p.select(F.col("top_cluster").cast("int"), *[F.col(v).cast("long").alias(v) for v in LANGS])


@register(
    "a8_sizes_desc",
    f"WITH {SUB_SQL} SELECT CAST(top_cluster AS INTEGER) AS top_cluster, subcluster, "
    "CAST(top_cluster AS VARCHAR) || '.' || subcluster AS label, members, "
    "CAST(row_number() OVER (ORDER BY members DESC, top_cluster, subcluster) AS INTEGER) AS position FROM sub",
)
def q_a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = _sub_sizes(spark, sf_dir)
    w = Window.orderBy(F.desc("members"), F.asc("top_cluster"), F.asc("subcluster"))
    # window over the aggregated (parent, sub) rows only
    return s.select(
        F.col("top_cluster").cast("int"),
        "subcluster",
        F.concat_ws(".", F.col("top_cluster").cast("string"), "subcluster").alias("label"),
        "members",
        F.row_number().over(w).cast("int").alias("position"),
    )

