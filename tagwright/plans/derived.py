"""Relations derived from the driver tables, each in Spark and in DuckDB SQL.

* marked conversations (FIXTURES F2): the driver's prose almost never contains
  a marker phrase, so a deterministic prefix and suffix are added to every
  assistant message.  An oracle on unmarked text would pass with a broken
  pattern.
* clustered responses (F4): ``embeddings.label`` is the cluster, the vector is
  ``embedding`` and the text is ``documents.text`` of the same id.
* reviewed labels and saved predictions (F5): eight tags with dyadic scores
  (exact in both engines) so evaluation and the sweep can be checked exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import sql_str
from ..session import read_table

# Test-fixture values (FIXTURES.md F2)
PREFIXES = [
    "", "Sure! ", "Here are the facts. ", "You're right. ", "I agree, of course. ", "Based on that, ",
    "Certainly. ", "Below is it. ",
]
SUFFIXES = [
    "",
    "\n- one\n- two",
    " Sorry, I cannot.",
    " Thanks.",
    " Delighted.",
    " It depends, however may might.",
    "\n\n1) First step\n2. Second example\n\nDone.",
    "\n```\ncode\n```\n",
    " Need more information.",
    " Perhaps.",
    " Try this: use and follow. Consider it.",
    " Revise the draft; add more add more.",
    " it may may_x émay MAY be",
]

N_TAGS = 8
TAGS = [f"tag_{k}" for k in range(N_TAGS)]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


def marked_conversations(conv: DataFrame) -> DataFrame:
    pre = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("conv_id") % 8 + 1).cast("int"))
    suf = F.element_at(
        F.array(*[F.lit(s) for s in SUFFIXES]), ((F.col("conv_id") + F.col("turn")) % 13 + 1).cast("int")
    )
    text = F.when(F.col("role") == "assistant", F.concat(pre, F.col("text"), suf)).otherwise(F.col("text"))
    return conv.withColumn("text", text)


MARKED_CONVERSATIONS_SQL = (
    "SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN "
    f"list_extract({_sql_list(PREFIXES)}, CAST(conv_id % 8 + 1 AS INTEGER)) || text || "
    f"list_extract({_sql_list(SUFFIXES)}, CAST((conv_id + turn) % 13 + 1 AS INTEGER)) "
    "ELSE text END AS text FROM conversations"
)


def clustered_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one response per embedded document, ``cluster`` = given label."""
    emb = read_table(spark, sf_dir, "embeddings")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return emb.join(docs, emb.vec_id == docs.doc_id).select(
        F.lit("train").alias("source_split"),
        F.col("vec_id").alias("source_row"),
        F.lit(0).cast("long").alias("response_index"),
        F.col("vec_id").cast("string").alias("prompt_id"),
        F.col("text").alias("assistant_output"),
        F.col("label").alias("cluster"),
        F.col("embedding"),
    )


CLUSTERED_RESPONSES_SQL = (
    "SELECT 'train' AS source_split, e.vec_id AS source_row, CAST(0 AS BIGINT) AS response_index, "
    "CAST(e.vec_id AS VARCHAR) AS prompt_id, d.text AS assistant_output, e.label AS cluster, e.embedding "
    "FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id"
)


def _is_true(k: int):
    return ((F.col("vec_id") * 11 + k * k * 7 + F.col("label")) % 5) == 0


def label_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 labels: ``id, 4 keys, true_tags, primary_tag, review_status,
    assistant_output, pos`` (``pos`` = position in the label file)."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    true_tags = F.filter(
        F.array(*[F.when(_is_true(k), F.lit(t)) for k, t in enumerate(TAGS)]), lambda x: x.isNotNull()
    )
    return (
        emb.join(docs, emb.vec_id == docs.doc_id, "left")
        .select(
            F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("id"),
            F.lit("test").alias("source_split"),
            F.col("vec_id").alias("source_row"),
            F.lit(0).cast("long").alias("response_index"),
            F.col("vec_id").cast("string").alias("prompt_id"),
            true_tags.alias("true_tags"),
            F.when(F.size(true_tags) > 0, true_tags[0]).alias("primary_tag"),
            F.when(F.col("vec_id") % 7 == 0, "pending").otherwise("reviewed").alias("review_status"),
            F.coalesce(F.col("text"), F.lit("")).alias("assistant_output"),
            F.col("vec_id").alias("pos"),
        )
    )


def prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 decision scores: ``4 keys, scores array<struct<tag, score>>`` in
    class order, plus ``pos`` (position in the prediction file)."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    scores = F.array(
        *[
            F.struct(
                F.lit(t).alias("tag"),
                (((F.col("vec_id") * 37 + k * 53) % 17).cast("double") / 4 - 2 + _is_true(k).cast("double")).alias(
                    "score"
                ),
            )
            for k, t in enumerate(TAGS)
        ]
    )
    return emb.select(
        F.lit("test").alias("source_split"),
        F.col("vec_id").alias("source_row"),
        F.lit(0).cast("long").alias("response_index"),
        F.col("vec_id").cast("string").alias("prompt_id"),
        scores.alias("scores"),
        F.col("vec_id").alias("pos"),
    )


def _sql_is_true(k: int) -> str:
    return f"((vec_id * 11 + {k * k * 7} + label) % 5 = 0)"


LABELS_SQL = (
    "SELECT 'r' || CAST(e.vec_id AS VARCHAR) AS id, 'test' AS source_split, e.vec_id AS source_row, "
    "CAST(0 AS BIGINT) AS response_index, CAST(e.vec_id AS VARCHAR) AS prompt_id, "
    "list_filter(["
    + ", ".join(f"CASE WHEN {_sql_is_true(k)} THEN '{t}' END" for k, t in enumerate(TAGS))
    + "], lambda x: x IS NOT NULL) AS true_tags, "
    "CASE WHEN e.vec_id % 7 = 0 THEN 'pending' ELSE 'reviewed' END AS review_status, "
    "coalesce(d.text, '') AS assistant_output, e.vec_id AS pos "
    "FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id"
)
# primary tag = first true tag
LABELS_FULL_SQL = f"SELECT *, true_tags[1] AS primary_tag FROM ({LABELS_SQL}) __l"

SCORES_LONG_SQL = " UNION ALL ".join(
    f"SELECT 'test' AS source_split, vec_id AS source_row, CAST(0 AS BIGINT) AS response_index, "
    f"CAST(vec_id AS VARCHAR) AS prompt_id, '{t}' AS tag, "
    f"CAST((vec_id * 37 + {k * 53}) % 17 AS DOUBLE) / 4 - 2 + CASE WHEN {_sql_is_true(k)} THEN 1 ELSE 0 END AS score, "
    "vec_id AS pos FROM embeddings"
    for k, t in enumerate(TAGS)
)
