"""Training corpus from ``documents``: language identification, line
deduplication, near-duplicate removal, mixing of the sources and packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.llm.common import cut_lineage, read_table
from tagwright.llm.language_id import UNKNOWN, fit, held_out, predict
from tagwright.llm.line_dedup import dedup_lines
from tagwright.llm.mixing import in_order, mix
from tagwright.llm.order_minhash import keep_one
from tagwright.llm.packing import pack
from tagwright.llm.pieces import tokenizer_path
from tagwright.llm.queries import prepare

#: a text that costs more bits a byte in its best language is in none of them
MAX_BITS_PER_BYTE = 7.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and texts in none of the learned languages go."""
    prepare(spark)
    trees = fit(docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang"))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    text = plain[docs.columns.index("text")]
    judged = predict(docs.toDF(*plain), trees, plain, text)
    alien = F.coalesce(F.col("bits_per_byte") > MAX_BITS_PER_BYTE, F.lit(False))
    return judged.where((F.col("lang_pred") != UNKNOWN) & ~alien).select(*plain).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    prepare(spark)
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix (a file holds a range of it)."""
    prepare(spark)
    return in_order(mix(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences, in the order of the mix.
    Files are read largest first, so the order is worked out again rather than
    taken from the reading: it follows from ids and sources alone."""
    prepare(spark)
    mixed = mix(docs).select("doc_id", "text", "mix_position")
    return pack(mixed, tokenizer_path("byte_bpe_50k.tiktoken"), order_col="mix_position")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: a trained model, sketches and a tokenizer: not for SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
