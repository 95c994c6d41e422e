"""Line deduplication across documents (DataFrame functions only).

Lines are exploded and normalised, each key's 128-bit digest is counted over
distinct documents, and keys found in ``min_docs`` documents or more lose
their lines everywhere except in the document with the largest id that holds
them.  The remaining lines are put together again in their old order.

Scale: only ``(digest, id)`` pairs are shuffled for counting (with map-side
partial aggregation, distinct pairs first, so a key held by a third of all
documents is spread over every task); the texts move once, for the last join,
where each meets the places of its dropped lines as one string of flags, so a
text of any number of dropped lines is read once.

Edge cases: null text counts as an empty text (one empty line); an empty
table gives an empty table; a document that loses all its lines keeps its row
with an empty text; rows that repeat an id are one document (each row loses
its own lines; a row is told by its id and the hash of its text); rows without an
id take no part in the counting and keep all their lines.  Other columns pass
through whatever their names (columns named ``n_lines`` / ``n_dropped`` are
replaced by the operator's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WS, ascii_lower, cut_lineage, strip_ws

MIN_CHARS = 40
MIN_DOCS = 5
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _flags(gone: Column) -> Column:
    """Sorted positions as text: ``1`` for each of them, ``0`` between them."""
    before = F.concat(F.array(F.lit(-1)), gone)
    return F.array_join(F.zip_with(before, gone, lambda a, b: F.concat(F.repeat(F.lit("0"), b - a - 1), F.lit("1"))), "")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """All columns of ``docs`` with the text rewritten, plus ``n_lines``
    (before dropping) and ``n_dropped``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = (
        docs.where(F.col(id_col).isNotNull())
        # a select of its own: beside the generator the hash would be worked out again for every line
        .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), _lines(text).alias("lines"))
        .select("id", "row", F.posexplode("lines").alias("pos", "line"))
        .select("id", "row", "pos", strip_ws(F.col("line")).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("id", "row", "pos", _digest(ascii_lower(F.col("line"))).alias("key"))
    )
    held = cut_lineage(held)
    shared = (
        held.groupBy("key")
        .agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("key", "keeper")
    )
    # a key that a third of all documents hold is dealt out over SALTS tasks
    salted = held.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    drops = (
        salted.join(shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"])
        .where(F.col("id") != F.col("keeper"))
        .groupBy("id", "row")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .select(F.col("id").alias("__id"), F.col("row").alias("__row"), _flags(F.col("gone")).alias("__flags"))
    )
    out = docs.drop("n_lines", "n_dropped").withColumn("__text", text)
    out = out.join(drops, (F.col(id_col) == F.col("__id")) & (F.xxhash64("__text") == F.col("__row")), "left")
    lines = _lines(F.col("__text"))
    left = F.zip_with(lines, F.split("__flags", ""), lambda line, gone: F.when(gone.isNull() | (gone != "1"), line))
    kept = F.when(F.col("__flags").isNull(), lines).otherwise(F.filter(left, lambda line: line.isNotNull()))
    out = out.withColumn("__kept", kept)
    return (
        out.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", (F.size(lines) - F.size("__kept")).cast("long"))
        .withColumn(text_col, F.array_join("__kept", "\n"))
        .drop("__kept", "__flags", "__id", "__row", "__text")
    )


def line_dedup_query(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


_DUCK_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""
lines AS (
  SELECT doc_id, pos, line, translate(trim(line, {_DUCK_WS}), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.keeper AS gone
  FROM lines l LEFT JOIN shared s ON l.key = s.key
)"""
LINE_DEDUP_SQL = f"""
WITH {LINES_SQL}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
