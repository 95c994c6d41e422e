"""Queries for splitting, flattening and text features (T1-T5, X1-X9) and
the flagship profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regex as rx
from ..functions import text as tx
from ..operators import profile as pf
from ..operators.responses import responses_from_flat
from ..operators.split import SplitFractions, split_assignment, split_counts
from ..session import read_table
from . import derived as dv
from . import sqltext as sq

from .registry import SEED, r6, register, s6


# ---------------------------------------------------------------------------
# shared SQL fragments
# ---------------------------------------------------------------------------

def split_sql(conv_cte: str, seed: int = SEED, fr: SplitFractions = SplitFractions()) -> str:
    """T1 in DuckDB: global row_number over the md5 order, exact sizes."""
    new = repr(1.0 - fr.discovery)
    vt = repr(fr.validation + fr.test)
    tshare = repr(fr.test / (fr.validation + fr.test))
    return f"""
    __ids AS (SELECT DISTINCT conv_id FROM {conv_cte}),
    __rk AS (SELECT conv_id, row_number() OVER (ORDER BY md5('{seed}:' || CAST(conv_id AS VARCHAR)), conv_id) - 1 AS r,
                    count(*) OVER () AS n FROM __ids),
    __s1 AS (SELECT *, n - CAST(ceil(CAST({new} AS DOUBLE) * n) AS BIGINT) AS n_disc FROM __rk),
    __s2 AS (SELECT *, CAST(ceil(CAST({vt} AS DOUBLE) * n_disc) AS BIGINT) AS n_vt FROM __s1),
    __s3 AS (SELECT *, n_disc - n_vt AS n_train, n_vt - CAST(ceil(CAST({tshare} AS DOUBLE) * n_vt) AS BIGINT) AS n_val FROM __s2),
    split AS (SELECT conv_id, CASE WHEN r < n_train THEN 'train' WHEN r < n_train + n_val THEN 'validation'
                    WHEN r < n_disc THEN 'test' ELSE 'new_data' END AS source_split FROM __s3)"""


def responses_sql(conv_cte_sql: str) -> str:
    """T4/T5 in DuckDB over a conversations relation; returns a WITH-body
    defining ``responses``."""
    strip = sq.strip("content")
    return f"""
    conv AS ({conv_cte_sql}),
    {split_sql("conv")},
    msgs AS (SELECT conv_id, turn, role, coalesce(text, 'None') AS content FROM conv),
    prompts AS (SELECT conv_id, arg_min(content, turn) FILTER (WHERE role = 'user') AS prompt FROM msgs GROUP BY conv_id),
    kept AS (SELECT * FROM (SELECT conv_id, turn, {strip} AS assistant_output FROM msgs WHERE role = 'assistant') WHERE assistant_output <> ''),
    responses AS (
      SELECT s.source_split, k.conv_id AS source_row,
             CAST(row_number() OVER (PARTITION BY k.conv_id ORDER BY k.turn) - 1 AS BIGINT) AS response_index,
             CAST(k.conv_id AS VARCHAR) AS prompt_id, coalesce(p.prompt, '') AS prompt, k.assistant_output
      FROM kept k JOIN split s ON k.conv_id = s.conv_id LEFT JOIN prompts p ON k.conv_id = p.conv_id)"""


MARKED_RESPONSES = responses_sql(dv.MARKED_CONVERSATIONS_SQL)
RAW_RESPONSES = responses_sql("SELECT * FROM conversations")


def marked_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = dv.marked_conversations(read_table(spark, sf_dir, "conversations"))
    split, _ = split_assignment(conv, "conv_id", seed=SEED)
    return responses_from_flat(conv, split)


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    split, _ = split_assignment(conv, "conv_id", seed=SEED)
    return responses_from_flat(conv, split)


# ---------------------------------------------------------------------------
# Flagship: conversations -> responses -> features -> profile by length band
# ---------------------------------------------------------------------------
BAND_WORDS = 50
MAX_BAND = 6


def length_band(text: str = "assistant_output"):
    return F.least(F.floor(tx.word_count(text) / BAND_WORDS), F.lit(MAX_BAND)).cast("int")


def _profile_sql(src: str, cluster_expr: str) -> str:
    t = "assistant_output"
    marker_sql = [
        sq.list_flag(t),
        sq.fence_flag(t),
        sq.flag(t, rx.REFUSAL),
        sq.flag(t, rx.POLITENESS_CLUSTER),
        sq.flag(t, rx.ASSIST_OPENING, True),
        sq.flag(t, rx.INFORMATION_OPENING, True),
        sq.flag(t, rx.VALIDATION_OPENING, True),
        sq.flag(t, rx.CLARIFICATION),
    ]
    pre = (
        f"SELECT {cluster_expr} AS cluster, CAST(length({t}) AS BIGINT) AS chars, {sq.word_count(t)} AS words, "
        + ", ".join(f"{m} AS f{i}" for i, m in enumerate(marker_sql))
        + f" FROM {src}"
    )
    fr = ", ".join(f"{s6(f'avg(f{i})')} AS {n}" for i, n in enumerate(pf.MARKER_FRACTIONS))
    return f"""
    SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS members,
           {s6('count(*) / sum(count(*)) OVER ()')} AS fraction, cluster = -1 AS is_noise,
           {s6('avg(chars)')} AS avg_chars, {s6('median(chars)')} AS median_chars,
           {s6('avg(words)')} AS avg_words, {s6('median(words)')} AS median_words, {fr}
    FROM ({pre}) __p GROUP BY cluster"""


def _round_profile(df: DataFrame) -> DataFrame:
    cols = ["fraction", "avg_chars", "median_chars", "avg_words", "median_words", *pf.MARKER_FRACTIONS]
    return df.select(
        F.col("cluster").cast("int").alias("cluster"),
        "members",
        *[r6(c).alias(c) for c in cols],
        "is_noise",
    )


@register(
    "flagship_length_band_profile",
    f"WITH {MARKED_RESPONSES} "
    + _profile_sql(
        "responses", f"least(CAST(floor({sq.word_count('assistant_output')} / {BAND_WORDS}) AS BIGINT), {MAX_BAND})"
    ),
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> split -> responses -> X1/X6 -> A1-A3 by length band."""
    resp = marked_responses(spark, sf_dir).withColumn("band", length_band())
    return _round_profile(pf.cluster_profile(resp, cluster_col="band"))


# ---------------------------------------------------------------------------
# T1 - T5
# ---------------------------------------------------------------------------
@register("t1_split_assignment", f"WITH {split_sql('conversations')} SELECT conv_id, source_split FROM split")
def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    split, _ = split_assignment(conv, "conv_id", seed=SEED)
    return conv.select("conv_id").distinct().select("conv_id", split.alias("source_split"))


@register(
    "t3_split_counts",
    f"WITH {split_sql('conversations')} SELECT source_split, count(*) AS rows, "
    f"{s6('count(*) / sum(count(*)) OVER ()')} AS fraction FROM split GROUP BY source_split",
)
def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_counts(q_split(spark, sf_dir))


@register("t4_responses_marked", f"WITH {MARKED_RESPONSES} SELECT * FROM responses")
def q_responses_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_responses(spark, sf_dir)


@register("t4_responses_raw", f"WITH {RAW_RESPONSES} SELECT * FROM responses")
def q_responses_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_responses(spark, sf_dir)


# ---------------------------------------------------------------------------
# X1 - X9
# ---------------------------------------------------------------------------
KEYS = ["source_split", "source_row", "response_index"]


@register(
    "x6_cluster_features",
    f"WITH {MARKED_RESPONSES} SELECT {', '.join(KEYS)}, {', '.join(sq.cluster_features('assistant_output'))} FROM responses",
)
def q_x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    resp = marked_responses(spark, sf_dir)
    cols = tx.cluster_feature_columns("assistant_output")
    out = resp.select(*KEYS, *cols)
    return out.select(*KEYS, *[r6(c).alias(c) for c in tx.CLUSTER_FEATURES])


@register(
    "x7_classifier_features",
    f"WITH {MARKED_RESPONSES} " + sq.classifier_features_cte("responses", "assistant_output", KEYS),
)
def q_x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    resp = marked_responses(spark, sf_dir).select(*KEYS, "assistant_output")
    out = tx.with_classifier_features(resp)
    return out.select(*KEYS, *[r6(c).alias(c) for c in tx.CLASSIFIER_FEATURES])


@register(
    "x7_classifier_features_documents",
    sq.classifier_features_cte("documents", "text", ["doc_id"]),
)
def q_x7_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tx.with_classifier_features(docs, text="text")
    return out.select("doc_id", *[r6(c).alias(c) for c in tx.CLASSIFIER_FEATURES])


@register(
    "x1_x5_text_shape",
    f"""WITH {MARKED_RESPONSES}
    SELECT {', '.join(KEYS)}, {sq.word_count('assistant_output')} AS words,
           CAST({sq.sentences('assistant_output')} AS BIGINT) AS sentences,
           CAST({sq.line_count('assistant_output')} AS BIGINT) AS lines,
           CAST({sq.list_lines('assistant_output')} AS BIGINT) AS list_lines,
           CAST({sq.paragraphs('assistant_output')} AS BIGINT) AS paragraphs
    FROM responses""",
)
def q_x1_x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    resp = marked_responses(spark, sf_dir)
    t = "assistant_output"
    return resp.select(
        *KEYS,
        tx.word_count(t).alias("words"),
        tx.sentence_count(t).alias("sentences"),
        tx.line_count(t).alias("lines"),
        tx.list_line_count(t).alias("list_lines"),
        tx.paragraph_count(t).alias("paragraphs"),
    )


@register(
    "x8_term_counts",
    f"""SELECT term, count(*) AS n FROM (SELECT unnest({sq.term_tokens('text')}) AS term FROM documents) GROUP BY term""",
)
def q_x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(tx.rx.WORD_RUN), 0)).alias("term"))
    return runs.where(tx.is_term("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@register(
    "x9_slugify",
    r"SELECT item_id, lower(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM benchmark",
)
def q_x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", tx.slugify("text").alias("slug"))




S2_CAP = 40


@register(
    "s2_capped_train_responses",
    f"WITH {RAW_RESPONSES}, capped AS (SELECT conv_id FROM split WHERE source_split = 'train' "
    f"ORDER BY conv_id LIMIT {S2_CAP}) SELECT r.* FROM responses r JOIN capped c ON r.source_row = c.conv_id",
)
def q_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split's first 40 conversations (by id), then flattened."""
    from ..sources.readers import cap_flat_conversations

    conv = read_table(spark, sf_dir, "conversations")
    split, _ = split_assignment(conv, "conv_id", seed=SEED)
    train = conv.where(split == "train")
    return responses_from_flat(cap_flat_conversations(train, "conv_id", S2_CAP), "train")
