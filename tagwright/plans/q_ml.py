"""Queries for sampling (T8-T13), embeddings (T14), feature algebra and
clustering (M1-M9), the classifier (C1-C5, C10), figure data (G1-G8) and the
cluster report (K6)."""

from __future__ import annotations

import math
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cluster as cl
from ..operators import grid as gd
from ..operators import profile as pf
from ..operators.classifier import train_tagger
from ..operators.embed import with_hashed_embedding
from ..operators.responses import preview_180, preview_300_oneline, sample_text
from ..operators.scale import Standardizer, feature_mode, fit_pca
from ..operators.split import cap_per_group, exact_sample
from ..operators.tagger import LinearTagModel, classify, tag_classes, weak_labels
from ..operators.training import training_counts, training_set
from ..session import cut_lineage, ensure_checkpoint_dir, read_table
from ..sources import readers as rd
from ..sources import sinks as sk
from . import derived as dv
from . import sqltext as sq
from .q_text import KEYS, marked_responses
from .registry import SEED, r6, register, s6
from .tag_matrix import TAG_MATRIX_MD, values_sql

CR = f"cr AS ({dv.CLUSTERED_RESPONSES_SQL})"
PRIOR_CLUSTER = 3
SAMPLE_SIZE = 100
CAP = 20
DIMS = 64


def _docs_as_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.lit("train").alias("source_split"),
        F.col("doc_id").alias("source_row"),
        F.lit(0).cast("long").alias("response_index"),
        F.col("doc_id").cast("string").alias("prompt_id"),
        F.col("text").alias("assistant_output"),
        "n_chars",
    )


@register(
    "t8_filter_prior_cluster",
    f"WITH {CR} SELECT doc_id AS source_row, n_chars FROM documents WHERE doc_id IN "
    f"(SELECT source_row FROM cr WHERE cluster = {PRIOR_CLUSTER} AND source_split = 'train' AND response_index = 0)",
)
def q_t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = dv.clustered_responses(spark, sf_dir)
    out = rd.filter_to_prior_cluster(_docs_as_responses(spark, sf_dir), prior, PRIOR_CLUSTER)
    return out.select("source_row", "n_chars")


@register(
    "t9_exact_sample",
    f"SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) <= {SAMPLE_SIZE}",
)
def q_t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_sample(read_table(spark, sf_dir, "documents"), "doc_id", SAMPLE_SIZE, SEED).select("doc_id")


@register(
    "t10_cap_per_subcluster",
    f"WITH {CR} SELECT cluster, source_row FROM cr QUALIFY row_number() OVER "
    f"(PARTITION BY cluster ORDER BY md5('{SEED}:' || CAST(source_row AS VARCHAR)), source_row) <= {CAP}",
)
def q_t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = dv.clustered_responses(spark, sf_dir).select("cluster", "source_row")
    return cap_per_group(cr, ["cluster"], "source_row", CAP, SEED)


def _weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    tm = rd.parse_tag_matrix(rd.lines_from_text(spark, TAG_MATRIX_MD))
    cr = dv.clustered_responses(spark, sf_dir).withColumn("top_cluster", F.col("cluster")).withColumn("sub", F.lit(0))
    return weak_labels(cr, tm, "top_cluster", "sub")


WEAK_SQL = f"{CR}, weak AS (SELECT cr.*, tm.tags FROM cr JOIN {values_sql()} ON cr.cluster = tm.top_cluster AND tm.subcluster = 0)"


@register("t11_weak_labels", f"WITH {WEAK_SQL} SELECT source_row, array_to_string(tags, ',') AS tags FROM weak")
def q_t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weak(spark, sf_dir).select("source_row", F.array_join("tags", ",").alias("tags"))


TRAINING_SQL = f"""{CR}, tm AS (SELECT * FROM {values_sql()}), member AS (
    SELECT cr.*, cluster AS top_cluster, CAST(source_row % 2 AS INTEGER) AS sub FROM cr), train AS (
    SELECT m.*, tm.tags FROM member m JOIN tm ON m.top_cluster = tm.top_cluster AND m.sub = tm.subcluster
    QUALIFY row_number() OVER (PARTITION BY m.top_cluster, m.sub
        ORDER BY md5('{SEED}:' || concat_ws(chr(31), source_split, source_row, response_index))) <= {CAP})"""


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The folders of a sub-clustering run are written as the job expects them
    and scanned by the library's own reader."""
    tm = rd.parse_tag_matrix(rd.lines_from_text(spark, TAG_MATRIX_MD))
    cr = dv.clustered_responses(spark, sf_dir).withColumnRenamed("cluster", "top").drop("embedding")
    cr = cr.withColumn("cluster", (F.col("source_row") % 2).cast("int"))
    root = posixpath.join(ensure_checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    # one join for all folders; each is then copied from its own part
    parts = f"{root}/parts"
    cr.where(F.col("top").between(0, 9)).write.partitionBy("top").parquet(parts)
    for top in range(10):
        one = spark.read.schema(cr.schema).parquet(parts).where(F.col("top") == top)
        sk.write_parquet(one.drop("top"), f"{root}/cluster_{top}/clustered_responses.parquet")
    return training_set(rd.subcluster_training_scan(spark, root), tm, cap=CAP, seed=SEED), tm


@register(
    "t10_t11_training_set",
    f"WITH {TRAINING_SQL} SELECT top_cluster, sub AS cluster, source_row, array_to_string(tags, ',') AS tags, "
    "md5(assistant_output) AS text_md5 FROM train",
)
def q_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _training(spark, sf_dir)
    return train.select(
        "top_cluster", "cluster", "source_row", F.array_join("tags", ",").alias("tags"), F.md5("assistant_output").alias("text_md5")
    )


@register(
    "t10_t11_training_counts",
    f"WITH {TRAINING_SQL} SELECT tm.top_cluster, tm.subcluster, count(t.source_row) AS rows, len(any_value(tm.tags)) AS n_tags "
    "FROM tm LEFT JOIN train t ON t.top_cluster = tm.top_cluster AND t.sub = tm.subcluster GROUP BY tm.top_cluster, tm.subcluster",
)
def q_training_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_counts(*_training(spark, sf_dir))


@register(
    "t13_previews",
    "SELECT doc_id, substr(text, 1, 180) AS preview, replace(substr(text, 1, 300), chr(10), ' ') AS oneline, "
    f"CASE WHEN length(text) > 1200 THEN regexp_replace(substr(text, 1, 1200), '{sq.WS}+$', '') || '...' ELSE text END AS sample "
    "FROM documents",
)
def q_t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", preview_180("text").alias("preview"), preview_300_oneline("text").alias("oneline"), sample_text("text").alias("sample"))


EMB_SQL = f"""
    toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{sq.rx.WORD_RUN}')) AS tok FROM documents),
    hb AS (SELECT doc_id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {DIMS} AS b,
                  CASE WHEN CAST('0x' || substr(md5(tok), 9, 1) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END AS s FROM toks),
    raw AS (SELECT doc_id, b, sum(s) AS v FROM hb GROUP BY doc_id, b),
    nrm AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM raw GROUP BY doc_id),
    vec AS (SELECT r.doc_id, r.b, CAST(CASE WHEN n.n > 0 THEN r.v / n.n ELSE 0.0 END AS FLOAT) AS v
            FROM raw r JOIN nrm n ON r.doc_id = n.doc_id),
    stats AS (SELECT doc_id, sum(CAST(v AS DOUBLE)) AS sum_v, sum(abs(CAST(v AS DOUBLE))) AS sum_abs,
                     arg_max(b, {{'v': v, 'nb': -b}}) AS argmax_dim,
                     sum(CASE WHEN b = 0 THEN CAST(v AS DOUBLE) ELSE 0.0 END) AS v0,
                     sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) AS sq FROM vec GROUP BY doc_id)"""


@register(
    "t14_hashed_embedding",
    f"WITH {EMB_SQL} SELECT d.doc_id, {s6('coalesce(sum_v, 0.0)')} AS sum_v, {s6('coalesce(sum_abs, 0.0)')} AS sum_abs, "
    f"CAST(coalesce(CASE WHEN sum_abs > 0 AND (SELECT max(v) FROM vec WHERE vec.doc_id = d.doc_id) > 0 THEN argmax_dim END, 0) AS INTEGER) AS argmax_dim, "
    f"{s6('coalesce(v0, 0.0)')} AS v0, {s6('coalesce(sq, 0.0)')} AS norm_sq FROM documents d LEFT JOIN stats s ON d.doc_id = s.doc_id",
)
def q_t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_hashed_embedding(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", DIMS, "e")
    dv_ = F.transform("e", lambda v: v.cast("double"))
    best = F.array_max(F.transform(dv_, lambda v, i: F.named_struct(F.lit("v"), v, F.lit("nb"), -i)))
    mx = F.array_max(dv_)
    return d.select(
        "doc_id",
        r6(F.aggregate(dv_, F.lit(0.0), lambda a, v: a + v)).alias("sum_v"),
        r6(F.aggregate(dv_, F.lit(0.0), lambda a, v: a + F.abs(v))).alias("sum_abs"),
        F.when(mx > 0, -best["nb"]).otherwise(F.lit(0)).cast("int").alias("argmax_dim"),
        r6(dv_[0]).alias("v0"),
        r6(F.aggregate(dv_, F.lit(0.0), lambda a, v: a + v * v)).alias("norm_sq"),
    )


# ----------------------------------------------------------------------------
# M1 - M9
# ----------------------------------------------------------------------------
M1_COLS = ["log_words", "words_per_sentence", "hedging_rate", "revision_signal_rate"]


@register(
    "m1_standardize",
    "WITH x7 AS (" + sq.classifier_features_cte("documents", "text", ["doc_id"], digits=None) + ") SELECT doc_id, "
    + ", ".join(
        f"{s6(f'CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END')} AS z_{c}"
        for c in M1_COLS
    )
    + " FROM x7",
)
def q_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tx.with_classifier_features(read_table(spark, sf_dir, "documents").select("doc_id", "text"), text="text")
    st = Standardizer.fit(docs, M1_COLS)
    return st.transform(docs).select("doc_id", *[r6(f"z_{c}").alias(f"z_{c}") for c in M1_COLS])


def _emb_cols(prefix: str = "e") -> list[str]:
    return [f"{prefix}{i}" for i in range(DIMS)]


M2_SQL = (
    f"WITH {CR}, b AS (SELECT source_row, embedding, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(DIMS))
    + ", "
    + ", ".join(sq.cluster_features("assistant_output", digits=15))
    + " FROM cr), z AS (SELECT source_row, "
    + ", ".join(
        f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN {w} * ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END AS z_{c}"
        for c, w in [(f"e{i}", 0.35) for i in range(DIMS)] + [(c, 2.0) for c in tx.CLUSTER_FEATURES]
    )
    + " FROM b) SELECT source_row, "
    + s6(" + ".join(f"z_{c} * z_{c}" for c in [f"e{i}" for i in range(DIMS)] + tx.CLUSTER_FEATURES))
    + " AS norm_sq, "
    + s6("z_e0")
    + " AS f0, "
    + s6("z_log_words")
    + " AS f_log_words FROM z"
)


@register("m2_combined_features", M2_SQL)
def q_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = dv.clustered_responses(spark, sf_dir)
    feats = cr.select("source_row", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)],
                      *[F.round(c, 15).alias(n) for c, n in zip(tx.cluster_feature_columns("assistant_output"), tx.CLUSTER_FEATURES, strict=True)])
    out = feature_mode(feats, "combined", _emb_cols(), tx.CLUSTER_FEATURES)
    n2 = F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v)
    return out.select(
        "source_row", r6(n2).alias("norm_sq"), r6(F.col("features")[0]).alias("f0"), r6(F.col("features")[DIMS]).alias("f_log_words")
    )


@register("m3_pca_explained_variance")
def q_m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INV: PCA(8) of the embeddings: descending ratios summing to <= 1 and
    orthonormal loadings (checked in tests)."""
    emb = read_table(spark, sf_dir, "embeddings")
    wide = emb.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)])
    model = fit_pca(wide, _emb_cols(), 8)
    rows = [(k, float(v)) for k, v in enumerate(model.explained_variance_ratio)]
    return spark.createDataFrame(rows, "component int, explained_variance_ratio double")


@register("m5_kmeans")
def q_m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INV: ML k-means (k=10) on the embeddings; members per cluster."""
    emb = read_table(spark, sf_dir, "embeddings")
    out, _ = cl.kmeans(emb, "embedding", k=10, seed=SEED)
    return pf.cluster_sizes(out).select("cluster", "members")


def _label_centres(spark: SparkSession, sf_dir: str) -> dict[int, list[float]]:
    emb = read_table(spark, sf_dir, "embeddings")
    return {r["cluster"]: list(r["centroid"]) for r in pf.centroids(emb, "embedding", "label").collect()}


CENT_SQL = f"""
    dims AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings),
    cent AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM dims GROUP BY label, i),
    dist AS (SELECT d.vec_id, c.label AS c, round(sqrt(sum((CAST(d.v AS DOUBLE) - c.m) * (CAST(d.v AS DOUBLE) - c.m))), 9) AS dd
             FROM dims d JOIN cent c ON d.i = c.i GROUP BY d.vec_id, c.label),
    best AS (SELECT vec_id, arg_min(c, {{'d': dd, 'c': c}}) AS assigned, min(dd) AS distance FROM dist GROUP BY vec_id)"""


@register("m6_nearest_centroid", f"WITH {CENT_SQL} SELECT vec_id, CAST(assigned AS INTEGER) AS assigned, {s6('distance')} AS distance FROM best")
def q_m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    out = cl.assign_nearest(emb, "embedding", _label_centres(spark, sf_dir))
    return out.select("vec_id", F.col("assigned").cast("int"), r6("assigned_distance").alias("distance"))


@register(
    "m6_lloyd_update",
    f"""WITH {CENT_SQL},
    nd AS (SELECT b.assigned, d.i, avg(CAST(d.v AS DOUBLE)) AS m FROM best b JOIN dims d ON b.vec_id = d.vec_id GROUP BY 1, 2),
    sz AS (SELECT assigned, count(*) AS members FROM best GROUP BY 1)
    SELECT CAST(nd.assigned AS INTEGER) AS cluster, any_value(sz.members) AS members, {s6('sqrt(sum(m * m))')} AS centroid_norm
    FROM nd JOIN sz ON nd.assigned = sz.assigned GROUP BY nd.assigned""",
)
def q_m6_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    assigned, cents = cl.lloyd_step(emb, "embedding", _label_centres(spark, sf_dir))
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, v: a + v * v))
    return cents.join(sizes, "cluster").select(F.col("cluster").cast("int"), "members", r6(norm).alias("centroid_norm"))


@register(
    "m8_run_facts",
    f"WITH {CENT_SQL} SELECT count(*) AS rows, count(DISTINCT assigned) AS cluster_count, CAST(0 AS BIGINT) AS noise_count, "
    f"{s6('0.0')} AS noise_fraction, {s6('sum(distance * distance)')} AS inertia FROM best",
)
def q_m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    out = cl.assign_nearest(emb, "embedding", _label_centres(spark, sf_dir), out="cluster")
    facts = cl.run_facts(out, extra=[F.sum(F.col("cluster_distance") * F.col("cluster_distance")).alias("inertia")])
    return facts.select(
        "rows", "cluster_count", F.col("noise_count").cast("long"), r6("noise_fraction").alias("noise_fraction"), r6("inertia").alias("inertia")
    )


M9_K, M9_ITERS = 3, 6


def _m9_sql(k: int = M9_K, iters: int = M9_ITERS) -> str:
    """Lloyd rounds unrolled: start from the first k members of each label in
    hash order, assign (distance rounded to 9 places, ties to the lower sub),
    average, repeat."""
    parts = [
        "dims AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)",
        f"seeds AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS sub "
        f"FROM embeddings QUALIFY sub < {k})",
        "c0 AS (SELECT s.label, s.sub, d.i, CAST(d.v AS DOUBLE) AS m FROM seeds s JOIN dims d ON s.vec_id = d.vec_id)",
    ]
    for it in range(iters):
        parts.append(
            f"d{it} AS (SELECT d.vec_id, d.label, c.sub, round(sum((CAST(d.v AS DOUBLE) - c.m) * (CAST(d.v AS DOUBLE) - c.m)), 9) AS dd "
            f"FROM dims d JOIN c{it} c ON d.label = c.label AND d.i = c.i GROUP BY d.vec_id, d.label, c.sub)"
        )
        parts.append(f"a{it} AS (SELECT vec_id, label, arg_min(sub, {{'d': dd, 's': sub}}) AS sub FROM d{it} GROUP BY vec_id, label)")
        if it < iters - 1:
            parts.append(
                f"c{it + 1} AS (SELECT a.label, a.sub, d.i, avg(CAST(d.v AS DOUBLE)) AS m FROM a{it} a JOIN dims d ON a.vec_id = d.vec_id "
                "GROUP BY a.label, a.sub, d.i)"
            )
    last = f"a{iters - 1}"
    return (
        "WITH " + ", ".join(parts)
        + f" SELECT CAST(label AS INTEGER) AS label, CAST(sub AS INTEGER) AS subcluster, count(*) AS members FROM {last} GROUP BY label, sub"
    )


@register("m9_grouped_subclusters", _m9_sql())
def q_m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: k-means with k=3 inside every label at once (6 Lloyd rounds from a
    hash-ordered start); members per (parent, sub)."""
    emb = read_table(spark, sf_dir, "embeddings")
    out = cl.grouped_kmeans(emb, "label", "vec_id", "embedding", k=M9_K, iterations=M9_ITERS, seed=SEED)
    return out.groupBy(F.col("label").cast("int").alias("label"), F.col("subcluster").cast("int").alias("subcluster")).agg(
        F.count(F.lit(1)).alias("members")
    )


# ----------------------------------------------------------------------------
# C1, C2, C3-C5, C10 and end-to-end tagging of new responses
# ----------------------------------------------------------------------------

@register(
    "c1_c2_class_weights",
    f"""WITH {WEAK_SQL}, ex AS (SELECT unnest(tags) AS tag FROM weak), n AS (SELECT count(*) AS n FROM weak)
    SELECT tag, CAST(count(*) AS BIGINT) AS n_pos, {s6('any_value(n) / (2.0 * count(*))')} AS weight_pos,
           {s6('CASE WHEN any_value(n) - count(*) > 0 THEN any_value(n) / (2.0 * (any_value(n) - count(*))) END')} AS weight_neg
    FROM ex, n GROUP BY tag""",
)
def q_c1_c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tagger import balanced_weights

    weak = _weak(spark, sf_dir)
    classes = tag_classes(weak, "tags")
    w = balanced_weights(weak, "tags", classes)
    return w.select("tag", F.col("n_pos").cast("long"), r6("weight_pos").alias("weight_pos"), r6("weight_neg").alias("weight_neg"))


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.with_classifier_features(_weak(spark, sf_dir).select("source_row", "assistant_output", "tags"))


def trained_model(spark: SparkSession, sf_dir: str, engine: str = "linear-svc") -> LinearTagModel:
    return train_tagger(_training_rows(spark, sf_dir), engine=engine)


@register("c3_squared_hinge_weights")
def q_c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INV: the fitted one-vs-rest weights (gradient ~ 0 checked in tests)."""
    m = trained_model(spark, sf_dir)
    rows = [(t, f, float(w)) for t, ws in zip(m.tags, m.weights, strict=True) for f, w in zip(m.features, ws, strict=True)]
    rows += [(t, "intercept", float(b)) for t, b in zip(m.tags, m.intercepts, strict=True)]
    return spark.createDataFrame(rows, "tag string, feature string, weight double")


@register("c4_hinge_support_vectors")
def q_c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INV: plain-hinge engine (Spark ML LinearSVC) with support-vector counts."""
    m = trained_model(spark, sf_dir, engine="svc")
    return spark.createDataFrame(sorted((m.support_vector_counts or {}).items()), "tag string, support_vectors int")


@register(
    "c10_run_header",
    f"""WITH {WEAK_SQL}
    SELECT 'one_vs_rest_linear_svm' AS algorithm, 'linear-svc' AS svm_engine, count(*) AS training_examples,
           CAST((SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM weak)) AS INTEGER) AS tag_count,
           CAST(-0.5 AS DOUBLE) AS threshold FROM weak""",
)
def q_c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run header of a prediction file (support-vector counts are
    only produced by the plain-hinge engine, see c4)."""
    from ..operators.tagger import run_header

    return run_header(spark, trained_model(spark, sf_dir), -0.5).drop("support_vector_counts")


@register("tag_new_responses")
def q_tag_new_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path 2 end to end: weak labels -> features -> fit -> tag every
    (marked) conversation response at threshold -0.5, max 5 tags."""
    model = trained_model(spark, sf_dir)
    resp = tx.with_classifier_features(marked_responses(spark, sf_dir))
    out = classify(resp, model.scores(), threshold=-0.5, max_predicted_tags=5, n_top=5)
    return out.select(*KEYS, "prompt_id", "response_preview", F.array_join("predicted_tags", ",").alias("predicted_tags"))


# ----------------------------------------------------------------------------
# G1 - G8 (x, y = embedding dimensions 1 and 2; cluster = label)
# ----------------------------------------------------------------------------

def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", F.col("label").alias("cluster"), F.col("embedding")[1].cast("double").alias("x"),
                      F.col("embedding")[2].cast("double").alias("y"))


XY = "xy AS (SELECT vec_id, label AS cluster, CAST(embedding[2] AS DOUBLE) AS x, CAST(embedding[3] AS DOUBLE) AS y FROM embeddings)"


@register("g1_pca_projection")
def q_g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INV: 2-D PCA projection of the embeddings (centred)."""
    emb = read_table(spark, sf_dir, "embeddings")
    wide = emb.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)])
    out, _ = gd.projection_2d(wide, _emb_cols())
    return out.select("vec_id", "x", "y")


def _hex_sql(nx: int = 70) -> str:
    ny = int(nx / math.sqrt(3))
    return f"""WITH {XY},
    b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM xy),
    p AS (SELECT x0 - 1e-9 * (x1 - x0) AS x0, x1 + 1e-9 * (x1 - x0) AS x1, y0 - 1e-9 * (y1 - y0) AS y0, y1 + 1e-9 * (y1 - y0) AS y1 FROM b),
    s AS (SELECT x0, y0, (x1 - x0) / {nx} AS sx, (y1 - y0) / {ny} AS sy FROM p),
    ij AS (SELECT (x - x0) / sx AS ix, (y - y0) / sy AS iy FROM xy, s),
    c AS (SELECT ix, iy, round_even(ix, 0) AS ix1, round_even(iy, 0) AS iy1, floor(ix) AS ix2, floor(iy) AS iy2 FROM ij),
    d AS (SELECT *, (ix - ix1) * (ix - ix1) + 3.0 * (iy - iy1) * (iy - iy1) AS d1,
                    (ix - ix2 - 0.5) * (ix - ix2 - 0.5) + 3.0 * (iy - iy2 - 0.5) * (iy - iy2 - 0.5) AS d2 FROM c),
    cells AS (SELECT CASE WHEN d1 < d2 THEN 1 ELSE 2 END AS lattice,
                     CAST(CASE WHEN d1 < d2 THEN ix1 ELSE ix2 END AS BIGINT) AS i,
                     CAST(CASE WHEN d1 < d2 THEN iy1 ELSE iy2 END AS BIGINT) AS j FROM d)
    SELECT lattice, i, j, count(*) AS count, {s6('log10(count(*))')} AS log_count FROM cells GROUP BY 1, 2, 3"""


@register("g2_hexbin_density", _hex_sql())
def q_g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = gd.hexbin_counts(_xy(spark, sf_dir))
    return h.select(F.col("lattice").cast("int"), "i", "j", "count", r6("log_count").alias("log_count"))


@register(
    "g3_g4_dominant_cells",
    f"""WITH {XY},
    q AS (SELECT quantile_cont(x, 0.01) AS xl, quantile_cont(x, 0.99) AS xh, quantile_cont(y, 0.01) AS yl, quantile_cont(y, 0.99) AS yh FROM xy),
    c0 AS (SELECT CAST(floor((x - xl) / ((xh - xl) / 94)) AS BIGINT) AS cx, CAST(floor((y - yl) / ((yh - yl) / 94)) AS BIGINT) AS cy, cluster FROM xy, q),
    per AS (SELECT cx, cy, cluster, count(*) AS n FROM c0 WHERE cx >= 0 AND cx < 94 AND cy >= 0 AND cy < 94 GROUP BY 1, 2, 3),
    dom AS (SELECT cx, cy, arg_max(cluster, {{'n': n, 'c': -cluster}}) AS dominant_cluster, sum(n) AS density FROM per GROUP BY 1, 2)
    SELECT cx, cy, CAST(dominant_cluster AS INTEGER) AS dominant_cluster, CAST(density AS BIGINT) AS density,
           {s6('least(greatest(ln(1 + density) / ln(1 + max(density) OVER ()), 0.18), 0.82)')} AS alpha FROM dom""",
)
def q_g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = gd.dominant_cells(_xy(spark, sf_dir))
    return d.select("cx", "cy", F.col("dominant_cluster").cast("int"), F.col("density").cast("long"), r6("alpha").alias("alpha"))


@register(
    "g5_cluster_centers_2d",
    f"WITH {XY} SELECT CAST(cluster AS INTEGER) AS cluster, {s6('avg(x)')} AS x, {s6('avg(y)')} AS y, "
    "CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster ' || CAST(cluster AS VARCHAR) END AS name FROM xy GROUP BY cluster",
)
def q_g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = gd.centers_2d(_xy(spark, sf_dir))
    return c.select(F.col("cluster").cast("int"), r6("x").alias("x"), r6("y").alias("y"), "name")


G6_SIZE = 300


@register(
    "g6_scatter_sample",
    f"WITH {XY} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM xy "
    f"QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) <= {G6_SIZE}",
)
def q_g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exact_sample(_xy(spark, sf_dir), "vec_id", G6_SIZE, SEED)
    return s.select("vec_id", F.col("cluster").cast("int"))


# Fixed two-tag model over 20 standardised features (FIXTURES F9).
G7_MODEL = LinearTagModel(
    tags=["tag_a", "tag_b"],
    weights=[[1.5, -0.5] + [0.0] * 18, [-0.75, 1.25] + [0.0] * 18],
    intercepts=[0.25, -0.125],
    mean=[0.0] * 20,
    scale=[1.0] * 20,
)


@register(
    "g7_decision_grid",
    f"""WITH {XY},
    q AS (SELECT quantile_cont(x, 0.05) AS xl, quantile_cont(x, 0.95) AS xh, quantile_cont(y, 0.05) AS yl, quantile_cont(y, 0.95) AS yh FROM xy),
    box AS (SELECT xl - greatest((xh - xl) * 0.12, 0.5) AS a, xh + greatest((xh - xl) * 0.12, 0.5) AS b,
                   yl - greatest((yh - yl) * 0.12, 0.5) AS c, yh + greatest((yh - yl) * 0.12, 0.5) AS d FROM q),
    g AS (SELECT CAST(range % 220 AS INTEGER) AS ix, CAST(range // 220 AS INTEGER) AS iy FROM range(48400)),
    p AS (SELECT ix, iy, CASE WHEN ix = 219 THEN b ELSE a + ix * ((b - a) / 219) END AS gx,
                 CASE WHEN iy = 219 THEN d ELSE c + iy * ((d - c) / 219) END AS gy FROM g, box),
    s AS (SELECT ix, iy, 0.25 + 1.5 * gx + -0.5 * gy AS sa, -0.125 + -0.75 * gx + 1.25 * gy AS sb FROM p)
    SELECT ix, iy, CASE WHEN sb > sa THEN 'tag_b' ELSE 'tag_a' END AS winning_tag, {s6('sa')} AS score_tag_a FROM s""",
)
def q_g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy = _xy(spark, sf_dir)
    box = gd.percentile_box(xy, 5, 95)
    inv = [F.col("gx"), F.col("gy")] + [F.lit(0.0)] * 18
    g = gd.decision_grid(spark, box, inv, G7_MODEL)
    return g.select("ix", "iy", "winning_tag", r6("score_tag_a").alias("score_tag_a"))


@register(
    "g8_mark_positives",
    f"WITH {WEAK_SQL} SELECT source_row, list_contains(tags, 'hedged') AS positive FROM weak "
    f"QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || CAST(source_row AS VARCHAR)), source_row) <= {G6_SIZE}",
)
def q_g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exact_sample(_weak(spark, sf_dir), "source_row", G6_SIZE, SEED)
    return gd.mark_positives(s, "tags", "hedged").select("source_row", "positive")


# ----------------------------------------------------------------------------
# K6 - cluster report lines
# ----------------------------------------------------------------------------

def _k6_sql() -> str:
    from .q_profile import REPS_SQL, _sample_sql

    t = "assistant_output"
    marks = [
        sq.list_flag(t), sq.fence_flag(t), sq.flag(t, sq.rx.REFUSAL), sq.flag(t, sq.rx.POLITENESS_CLUSTER),
        sq.flag(t, sq.rx.ASSIST_OPENING, True), sq.flag(t, sq.rx.INFORMATION_OPENING, True),
        sq.flag(t, sq.rx.VALIDATION_OPENING, True), sq.flag(t, sq.rx.CLARIFICATION),
    ]
    labels = [
        "List format", "Code blocks", "Refusal markers", "Politeness markers", "Agree-to-help openings",
        "Agree-to-inform openings", "Agree-with-user openings", "Clarification/uncertainty",
    ]
    pre = f"SELECT cluster, {sq.word_count(t)} AS words, " + ", ".join(f"{m} AS f{i}" for i, m in enumerate(marks)) + " FROM cr"
    prof = (
        "SELECT cluster, count(*) AS members, count(*) / sum(count(*)) OVER () AS fraction, avg(words) AS avg_words, "
        + ", ".join(f"avg(f{i}) AS f{i}" for i in range(8))
        + f" FROM ({pre}) GROUP BY cluster"
    )
    head = [
        "'## ' || CASE WHEN p.cluster = -1 THEN 'Noise' ELSE 'Cluster ' || CAST(p.cluster AS VARCHAR) END",
        "''",
        "'- Members: ' || CAST(members AS VARCHAR)",
        "'- Fraction: ' || printf('%.2f%%', fraction * 100)",
        "'- Avg words: ' || printf('%.1f', avg_words)",
        *[f"'- {lab}: ' || printf('%.2f%%', f{i} * 100)" for i, lab in enumerate(labels)],
        "'- Top terms: ' || coalesce(tl.terms, '')",
        "''",
    ]
    a4 = (
        f"tk AS (SELECT cluster, source_split, source_row, response_index, {sq.term_tokens(t)} AS toks FROM cr), "
        "toks AS (SELECT cluster, source_split, source_row, response_index, unnest(toks) AS term, "
        "unnest(generate_series(0, len(toks) - 1)) AS pos FROM tk), "
        "tc AS (SELECT cluster, term, count(*) AS count, min({'a': source_split, 'b': source_row, 'c': response_index, 'd': pos}) AS first "
        "FROM toks GROUP BY cluster, term), "
        "tr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, first) AS rank FROM tc), "
        "tl AS (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS terms FROM tr WHERE rank <= 10 GROUP BY cluster)"
    )
    return (
        REPS_SQL
        + f", prof AS ({prof}), {a4}, "
        + f"picked AS (SELECT r.cluster, r.rank, {_sample_sql('cr.assistant_output')} AS sample FROM ranked r "
        "JOIN cr ON r.cluster = cr.cluster AND r.source_row = cr.source_row WHERE r.rank <= 5), "
        "head AS (SELECT p.cluster, unnest(["
        + ", ".join(head)
        + "]) AS line, unnest(generate_series(0, 14)) AS line_no FROM prof p LEFT JOIN tl ON p.cluster = tl.cluster) "
        "SELECT CAST(cluster AS INTEGER) AS cluster, CAST(line_no AS INTEGER) AS line_no, line FROM head "
        "UNION ALL SELECT CAST(cluster AS INTEGER), CAST(100 + rank * 2 AS INTEGER), "
        "'Sample ' || CAST(rank AS VARCHAR) || ': ' || replace(sample, chr(10), ' ') FROM picked "
        "UNION ALL SELECT CAST(cluster AS INTEGER), CAST(101 + rank * 2 AS INTEGER), '' FROM picked"
    )


@register("k6_cluster_report_lines", _k6_sql())
def q_k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = dv.clustered_responses(spark, sf_dir)
    summary = pf.cluster_profile(cr)
    terms = pf.top_terms(cr, KEYS, limit=10)
    reps = pf.representatives(cr, "embedding", KEYS, limit=5)
    samples = reps.select("cluster", "rank", sample_text("assistant_output").alias("assistant_output"))
    return sk.cluster_report_lines(summary, terms, samples)



# ----------------------------------------------------------------------------
# M4 / M7 - neighbour graph and density clustering
# ----------------------------------------------------------------------------
KNN_K = 15


@register(
    "m4_knn_graph",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 12), nbr) AS rank FROM d)
    SELECT id, CAST(rank AS INTEGER) AS rank, nbr, {s6('dist')} AS dist FROM r WHERE rank <= {KNN_K}""",
)
def q_m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.density import knn_graph

    emb = read_table(spark, sf_dir, "embeddings")
    g = knn_graph(emb, "vec_id", "embedding", k=KNN_K, metric="euclidean")
    return g.select("id", F.col("rank").cast("int"), "nbr", r6("dist").alias("dist"))


@register("m7_density_clusters")
def q_m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INV + brute force (tests): HDBSCAN*-style clustering of the embeddings
    with min_cluster_size 50 (the reference default)."""
    from ..operators.density import hdbscan

    emb = read_table(spark, sf_dir, "embeddings")
    labels, _ = hdbscan(emb, "vec_id", "embedding", min_cluster_size=50)
    return labels


@register("m7_m8_density_run_facts")
def q_m7_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 for M7: cluster count (noise excluded), noise count and fraction."""
    return cl.run_facts(q_m7(spark, sf_dir))


@register("m7_behavior_density_clusters")
def q_m7_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 (behavior mode) + M7 on the marked responses: standardised
    10-feature behaviour vectors, min_cluster_size 15, min_samples 5.  Output:
    members and mean marker flags per found cluster."""
    from ..operators.density import hdbscan

    resp = marked_responses(spark, sf_dir)
    feats = cut_lineage(
        resp.select(*KEYS, *tx.cluster_feature_columns("assistant_output")).withColumn("rid", F.xxhash64(*KEYS))
    )  # read three times, and the text patterns are slow
    vecs = feature_mode(feats, "behavior", [], tx.CLUSTER_FEATURES)
    labels, _ = hdbscan(vecs, "rid", "features", min_cluster_size=15, min_samples=5)
    j = feats.join(labels, "rid")
    return j.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"),
        *[F.round(F.avg(c), 3).alias(c) for c in ["list_format", "code_block", "refusal_marker", "politeness_marker"]],
    )


@register(
    "m4_knn_graph_cosine",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT a.vec_id AS id, b.vec_id AS nbr, 1.0 - list_cosine_similarity(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 12), nbr) AS rank FROM d)
    SELECT id, CAST(rank AS INTEGER) AS rank, nbr, {s6('dist')} AS dist FROM r WHERE rank <= {KNN_K}""",
)
def q_m4_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 with the cosine distance the reference's neighbour graph uses."""
    from ..operators.density import knn_graph

    emb = read_table(spark, sf_dir, "embeddings")
    g = knn_graph(emb, "vec_id", "embedding", k=KNN_K, metric="cosine")
    return g.select("id", F.col("rank").cast("int"), "nbr", r6("dist").alias("dist"))


# M7 steps: core distances and the spanning tree
MST_SAMPLES = 5


def _mst_sql(rounds: int = 14, jumps: int = 12) -> str:
    """Boruvka rounds unrolled: per component its lightest outgoing edge in the
    order (weight, smaller id, larger id), then pointers jumped to the root."""
    ctes = [
        "e AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
        "d AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.id < b.id)",
        "twice AS (SELECT a AS id, dist FROM d UNION ALL SELECT b, dist FROM d UNION ALL SELECT id, 0.0 FROM e)",
        f"""core AS MATERIALIZED (SELECT id, max(dist) AS core FROM (
                SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS r FROM twice) WHERE r <= {MST_SAMPLES} GROUP BY id)""",
        "w AS MATERIALIZED (SELECT a, b, greatest(dist, x.core, y.core) AS w FROM d JOIN core x ON x.id = a JOIN core y ON y.id = b)",
        "c0 AS MATERIALIZED (SELECT id, id AS comp FROM e)",
    ]
    for r in range(rounds):
        ctes.append(
            f"""x{r} AS MATERIALIZED (SELECT w, a, b, p.comp AS ca, q.comp AS cb FROM w JOIN c{r} p ON p.id = a JOIN c{r} q ON q.id = b WHERE p.comp <> q.comp)"""
        )
        ctes.append(
            f"""m{r} AS MATERIALIZED (SELECT comp, arg_min({{'a': a, 'b': b, 'o': o}}, {{'w': w, 'a': a, 'b': b}}) AS t FROM (
                SELECT ca AS comp, cb AS o, w, a, b FROM x{r} UNION ALL SELECT cb, ca, w, a, b FROM x{r}) GROUP BY comp)"""
        )
        ctes.append(
            f"""p{r}_0 AS MATERIALIZED (SELECT s.comp, CASE WHEN s.t.o IS NULL OR (o.t.o = s.comp AND s.comp < s.t.o) THEN s.comp ELSE s.t.o END AS up
                FROM (SELECT k.comp, m{r}.t FROM (SELECT DISTINCT comp FROM c{r}) k LEFT JOIN m{r} USING (comp)) s LEFT JOIN m{r} o ON o.comp = s.t.o)"""
        )
        for j in range(jumps if r < 4 else 6):
            ctes.append(f"p{r}_{j + 1} AS MATERIALIZED (SELECT x.comp, y.up FROM p{r}_{j} x JOIN p{r}_{j} y ON y.comp = x.up)")
        last = f"p{r}_{jumps if r < 4 else 6}"
        ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT id, up AS comp FROM c{r} JOIN {last} USING (comp))")
    edges = " UNION ".join(f"SELECT t.a AS a, t.b AS b FROM m{r}" for r in range(rounds))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT a, b, {s6('w')} AS w FROM w JOIN ({edges}) USING (a, b)"


@register("m7_mst_edges", _mst_sql())
def q_m7_mst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning tree of the mutual reachability distances."""
    from ..operators.density import mutual_reachability_mst

    emb = read_table(spark, sf_dir, "embeddings")
    _, edges = mutual_reachability_mst(emb, "vec_id", "embedding", MST_SAMPLES)
    return edges.select("a", "b", r6("w").alias("w"))


@register(
    "m7_core_distances",
    f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT a.id, list_distance(a.v, b.v) AS dist FROM e a CROSS JOIN e b),
    r AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS r FROM d)
    SELECT id, {s6('max(dist)')} AS core FROM r WHERE r <= {MST_SAMPLES} GROUP BY id""",
)
def q_m7_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the fifth nearest vector, the vector itself counted first."""
    from ..operators.density import core_distances

    emb = read_table(spark, sf_dir, "embeddings")
    return core_distances(emb, "vec_id", "embedding", MST_SAMPLES).select("id", r6("core").alias("core"))
