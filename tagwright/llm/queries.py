"""One query per operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ensure_checkpoint_dir, read_table, ship_package
from .html_text import html_text_query
from .language_id import language_id_query
from .lexical_search import LEXICAL_SEARCH_SQL, lexical_search_query
from .line_dedup import LINE_DEDUP_SQL, line_dedup_query
from .mixing import mixing_query
from .nearest import nearest_query
from .order_minhash import near_duplicates_query
from .packing import packing_query
from .privacy import privacy_query
from .quality_rules import quality_rules_query
from .token_counts import token_counts_query
from .tokenizer_align import tokenizer_align_query
from .toxicity import toxicity_query

#: rows per Arrow batch: texts can be long
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """What every query of this subpackage needs from the session."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def _query(run: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return run(*[read_table(spark, sf_dir, t) for t in tables])

    query.__name__ = run.__name__
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": _query(quality_rules_query, "documents", "labels"),
    "op2_nearest": _query(nearest_query, "embeddings"),
    "op3_personal_data": _query(privacy_query, "documents"),
    "op4_html_text": _query(html_text_query, "pages"),
    "op5_packing": _query(packing_query, "documents"),
    "op6_line_dedup": _query(line_dedup_query, "documents"),
    "op7_near_duplicates": _query(near_duplicates_query, "documents"),
    "op8_language_id": _query(language_id_query, "documents"),
    "op9_mixing": _query(mixing_query, "documents"),
    "op10_token_counts": _query(token_counts_query, "documents"),
    "op11_tokenizer_align": _query(tokenizer_align_query, "documents"),
    "op12_toxicity": _query(toxicity_query, "documents", "labels"),
    "op13_lexical_search": _query(lexical_search_query, "documents", "benchmark"),
}

ORACLE: dict[str, str] = {"op6_line_dedup": LINE_DEDUP_SQL, "op13_lexical_search": LEXICAL_SEARCH_SQL}
