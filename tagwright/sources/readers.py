"""Readers (S1-S17).

Files that a person writes by hand (tag matrix, reviewed labels, a JSON list)
are small and are read whole; everything data-sized (parquet, JSON lines,
clustered responses) is read line- or row-parallel.  Bad input rows are
collected into an error frame; ``strict=True`` raises naming at most five of
them, before any downstream job starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regex import LINE_BREAK, WS
from ..functions.text import strip

RESPONSE_FIELDS = ("response", "assistant_output")
ITEM_SCHEMA = "response string, metadata map<string,string>, item_file string, item_no long"


class InputError(ValueError):
    pass


# ----------------------------------------------------------------------------
# Parquet inputs
# ----------------------------------------------------------------------------

def load_source(spark: SparkSession, path: str) -> DataFrame:
    """The source conversations (parquet in place of a hub download)."""
    return spark.read.parquet(path)


def cap_conversations(df: DataFrame, order_cols: Sequence[str], max_rows: int | None) -> DataFrame:
    """The first ``max_rows`` *conversations* in file order (a cap is the
    feature here; applied before flattening)."""
    return df if max_rows is None else df.orderBy(*order_cols).limit(max_rows)


def cap_flat_conversations(conv: DataFrame, id_col: str, max_rows: int | None) -> DataFrame:
    """S2 for flat message rows: keep the messages of the first ``max_rows``
    conversation ids (a top-k over distinct ids, then a semi join)."""
    if max_rows is None:
        return conv
    ids = conv.select(id_col).distinct().orderBy(id_col).limit(max_rows)
    return conv.join(ids, id_col, "left_semi")


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    """Schema checks that fail before any job runs."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise InputError(f"missing columns in {what}: {missing}")
    return df


def load_embedding_split(
    spark: SparkSession, metadata_path: str, vectors_path: str | None = None, keys: Sequence[str] = ("source_split", "source_row", "response_index")
) -> DataFrame:
    """S3: responses with their vectors.  When the vectors live in a separate
    keyed table, both anti-joins must be empty (the reference's row-count
    check, made key-based)."""
    meta = spark.read.parquet(metadata_path)
    if vectors_path is None:
        return require_columns(meta, ["embedding"], metadata_path)
    vec = spark.read.parquet(vectors_path)
    k = list(keys)
    if not meta.join(vec, k, "left_anti").isEmpty() or not vec.join(meta, k, "left_anti").isEmpty():
        raise InputError("metadata rows and embedding rows do not match")
    return meta.join(vec, k)


def stack_splits(frames: Sequence[DataFrame]) -> DataFrame:
    """Several splits as one frame."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def filter_to_prior_cluster(
    df: DataFrame, prior: DataFrame, cluster: int, keys: Sequence[str] = ("source_split", "source_row", "response_index")
) -> DataFrame:
    """T8 (with S5's checks): keep the rows whose 3-part key is in cluster
    ``cluster`` of a prior clustering - a left-semi join, so duplicates in
    the prior table cannot multiply rows."""
    require_columns(prior, ["cluster", *keys], "prior clustering")
    require_columns(df, list(keys), "responses")
    sel = prior.where(F.col("cluster") == cluster).select(*keys)
    if sel.isEmpty():
        raise InputError(f"the prior clustering has no rows in cluster {cluster}")
    out = df.join(sel, list(keys), "left_semi")
    if out.isEmpty():
        raise InputError(f"no response matches a row of cluster {cluster}")
    return out


def subcluster_training_scan(spark: SparkSession, root: str) -> DataFrame:
    """One scan over ``root/cluster_*/clustered_responses.parquet``; the
    top cluster id comes from the folder name (missing folders simply do not
    appear; no folder at all is an :class:`InputError`)."""
    try:
        df = spark.read.parquet(f"{root.rstrip('/')}/cluster_*/clustered_responses.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise InputError(f"{root} holds no cluster_*/clustered_responses.parquet") from e
    require_columns(df, ["assistant_output", "cluster"], root)
    top = F.regexp_extract(F.col("_metadata.file_path"), r"/cluster_([0-9]+)/clustered_responses\.parquet(/[^/]+)?$", 1)
    return df.withColumn("top_cluster", F.when(top != "", top.cast("int"))).where(F.col("top_cluster").isNotNull())


# ----------------------------------------------------------------------------
# Tag matrix
# ----------------------------------------------------------------------------

def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """A small hand-written text file as ``(line_no, line)`` (1-based), lines
    broken the way ``str.splitlines`` breaks them."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", LINE_BREAK)).alias("line_no", "line")).select(
        (F.col("line_no") + 1).alias("line_no"), "line"
    )


def lines_from_text(spark: SparkSession, text: str) -> DataFrame:
    rows = [(i + 1, line) for i, line in enumerate(text.splitlines())]
    return spark.createDataFrame(rows, "line_no long, line string")


def parse_tag_matrix(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``(top_cluster, subcluster, tags)`` from Markdown table lines.

    A row starts with ``"| "`` and has exactly 4 cells; the first is
    ``N.M``; tags are the back-ticked names in cells 2 and 3, deduplicated and
    sorted; rows without tags are skipped; the last duplicate wins.
    """
    body = F.regexp_replace(strip(F.col("line")), r"^\|+|\|+\z", "")
    cells = F.transform(F.split(body, r"\|", -1), lambda c: strip(c))
    tick = r"`([^`]+)`"
    x = lines.where(F.col("line").startswith("| ")).select("line_no", cells.alias("cells"))
    x = x.where((F.size("cells") == 4) & ~F.col("cells")[0].isin("Subcluster", "---"))
    x = x.where(F.col("cells")[0].rlike(r"^[0-9]+\.[0-9]+$"))
    tags = F.array_sort(
        F.array_distinct(F.concat(F.regexp_extract_all(F.col("cells")[1], F.lit(tick), 1), F.regexp_extract_all(F.col("cells")[2], F.lit(tick), 1)))
    )
    x = x.select(
        F.split(F.col("cells")[0], r"\.")[0].cast("int").alias("top_cluster"),
        F.split(F.col("cells")[0], r"\.")[1].cast("int").alias("subcluster"),
        tags.alias("tags"),
        "line_no",
    ).where(F.size("tags") > 0)
    out = x.groupBy("top_cluster", "subcluster").agg(F.max_by("tags", "line_no").alias("tags"))
    if strict and out.isEmpty():
        raise InputError("no subcluster tags parsed from the tag matrix")
    return out


# ----------------------------------------------------------------------------
# Responses to tag
# ----------------------------------------------------------------------------

def _items_from_json_text(js: Column) -> Column:
    """One JSON value (text) -> struct(kind, response, metadata).

    kind: 'string', 'object', 'object-without-response', 'other'."""
    t = F.ltrim(js)
    as_string = F.from_json(F.concat(F.lit('{"v":'), js, F.lit("}")), "v string")["v"]
    as_map = F.from_json(js, "map<string,string>")
    has_resp = F.map_contains_key(as_map, F.lit("response"))
    value = F.when(has_resp, as_map["response"]).otherwise(F.try_element_at(as_map, F.lit("assistant_output")))
    meta = F.map_filter(as_map, lambda k, v: ~k.isin(*RESPONSE_FIELDS))
    kind = (
        F.when(t.startswith('"'), F.lit("string"))
        .when(t.startswith("{") & as_map.isNotNull() & value.isNotNull(), F.lit("object"))
        .when(t.startswith("{"), F.lit("object-without-response"))
        .otherwise(F.lit("other"))
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "string", as_string).when(kind == "object", value).alias("response"),
        F.when(kind == "object", meta).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def _split_errors(parsed: DataFrame, strict: bool, what: str) -> tuple[DataFrame, DataFrame]:
    ok = parsed.where(F.col("item.kind").isin("string", "object"))
    bad = parsed.where(~F.col("item.kind").isin("string", "object"))
    if strict:
        sample = bad.select("item_file", "item_no", "item.kind").orderBy("item_file", "item_no").limit(5).collect()
        if sample:
            raise InputError(f"{what}: unusable items {[(r['item_no'], r['kind']) for r in sample]}")
    return ok.select("item.response", "item.metadata", "item_file", "item_no"), bad


def read_jsonl_responses(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One item per non-blank line: a string, or an object with
    ``response`` (else ``assistant_output``); other fields become metadata.
    Line-parallel (``read.text``); the line number is kept per file."""
    # (item_file, item_no) is the file order: rows keep their offset order
    # inside a file, and part files sort by name
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("item_file"), F.monotonically_increasing_id().alias("item_no")
    )
    parsed = raw.where(F.col("value").rlike(f"[^{WS[1:-1]}]")).select(
        "item_file", "item_no", _items_from_json_text(F.col("value")).alias("item")
    )
    ok, _ = _split_errors(parsed, strict, path)
    return ok


def read_json_list_responses(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A JSON list of strings / objects.  One JSON document is one record,
    so this input does not split; prefer JSON lines (S8) for large inputs."""
    whole = spark.read.text(path, wholetext=True)
    v = F.try_parse_json(F.col("value"))
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    if strict and not whole.where(~F.coalesce(is_list, F.lit(False))).isEmpty():
        raise InputError(".json input must be a list of strings or objects")
    arr = F.from_json(F.col("value"), "array<variant>")
    items = whole.where(is_list).select(F.col("_metadata.file_path").alias("item_file"), F.posexplode(arr).alias("item_no", "x"))
    parsed = items.select("item_file", "item_no", _items_from_json_text(F.to_json("x")).alias("item"))
    ok, _ = _split_errors(parsed, strict, path)
    return ok


def read_parquet_responses(spark: SparkSession, path: str) -> DataFrame:
    """``assistant_output`` required; every other non-null column becomes
    a metadata entry (as text)."""
    df = require_columns(spark.read.parquet(path), ["assistant_output"], path)
    others = [c for c in df.columns if c != "assistant_output"]
    kv = []
    for c in others:
        kv += [F.lit(c), F.col(c).cast("string")]
    meta = F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull()) if kv else F.create_map().cast("map<string,string>")
    return df.select(
        F.col("assistant_output").cast("string").alias("response"),
        meta.alias("metadata"),
        F.col("_metadata.file_path").alias("item_file"),
        F.monotonically_increasing_id().alias("item_no"),
    )


def read_text_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses separated by blank lines, stripped, empties dropped."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.split(F.col("value"), f"\\n{WS}*\\n")
    return (
        whole.select(F.col("_metadata.file_path").alias("item_file"), F.posexplode(parts).alias("item_no", "part"))
        .select(strip("part").alias("response"), F.create_map().cast("map<string,string>").alias("metadata"), "item_file", "item_no")
        .where(F.col("response") != "")
    )


def load_responses(
    spark: SparkSession, inline: Sequence[str] = (), file_frame: DataFrame | None = None, max_responses: int | None = None
) -> DataFrame:
    """Inline responses first, then the file's, then an optional cap;
    an error when nothing is left."""
    first = spark.createDataFrame(
        [(r, {}, "", i) for i, r in enumerate(inline)],
        "response string, metadata map<string,string>, item_file string, item_no long",
    ).withColumn("__src", F.lit(0))
    out = first
    if file_frame is not None:
        out = out.unionByName(file_frame.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    if max_responses is not None:
        # a cap is the feature here: the first max_responses in input order
        out = out.orderBy("__src", "item_file", "item_no").limit(max_responses)
    if out.isEmpty():
        raise InputError("pass at least one response or an input file")
    return out.drop("__src")


# ----------------------------------------------------------------------------
# Run artefacts
# ----------------------------------------------------------------------------

PREDICTION_RESULT = T.StructType(
    [
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("response_preview", T.StringType()),
        T.StructField("predicted_tags", T.ArrayType(T.StringType())),
        T.StructField(
            "top_tags",
            T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("score", T.DoubleType())])),
        ),
    ]
)


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """S13 input side: prediction records as JSON lines (our K8 format), with
    the 4-part key lifted out of ``metadata`` and the file position kept."""
    # file order: part files in name order, rows in offset order inside each
    # (chunks of one file land in consecutive partitions, so the id grows)
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    df = spark.read.schema(PREDICTION_RESULT).option("mode", "FAILFAST").json(path).withColumn("pos", pos)
    if df.where(F.col("metadata").isNotNull()).isEmpty() and not df.isEmpty():
        raise InputError(f"{path} holds no prediction lines (a single document is read by read_prediction_document)")
    return _prediction_rows(df)


def read_prediction_document(spark: SparkSession, path: str) -> DataFrame:
    """S13 input side: one document ``{..., "results": [...]}`` per file; the
    position is the file and the place in its list."""
    schema = T.StructType([T.StructField("results", T.ArrayType(PREDICTION_RESULT))])
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not docs.where(F.col("results").isNull()).isEmpty():
        raise InputError(f"{path} has no list of results")
    rows = docs.select(F.col("_metadata.file_path").alias("file"), F.posexplode("results").alias("row", "r"))
    return _prediction_rows(rows.select("r.*", F.struct("file", F.col("row").cast("long").alias("row")).alias("pos")))


def _prediction_rows(df: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return df.select(
        m["source_split"].alias("source_split"),
        m["source_row"].cast("long").alias("source_row"),
        m["response_index"].cast("long").alias("response_index"),
        m["prompt_id"].alias("prompt_id"),
        "predicted_tags",
        "top_tags",
        "pos",
    )


LABEL_ENTRIES = (
    "array<struct<id:string,metadata:map<string,string>,true_tags:array<string>,primary_tag:string,"
    "review_status:string,assistant_output:string>>"
)


def read_label_entries(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed labels as a JSON list or an object with an ``entries``
    list (a small hand-reviewed file); anything else is an error."""
    whole = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    arr = F.when(kind.startswith("ARRAY"), F.to_json(v)).when(
        F.schema_of_variant(F.variant_get(v, "$.entries", "variant")).startswith("ARRAY"), F.to_json(F.variant_get(v, "$.entries", "variant"))
    )
    if whole.where(arr.isNull()).limit(1).count():
        raise InputError("labels JSON must be a list or an object with an entries list")
    entries = whole.select(F.posexplode(F.from_json(arr, LABEL_ENTRIES)).alias("pos", "e"))
    m = F.col("e.metadata")
    return entries.select(
        F.col("e.id").alias("id"),
        m["source_split"].alias("source_split"),
        m["source_row"].cast("long").alias("source_row"),
        m["response_index"].cast("long").alias("response_index"),
        m["prompt_id"].alias("prompt_id"),
        F.col("e.true_tags").alias("true_tags"),
        F.col("e.primary_tag").alias("primary_tag"),
        F.col("e.review_status").alias("review_status"),
        F.col("e.assistant_output").alias("assistant_output"),
        "pos",
    )


SWEEP_CSV_SCHEMA = (
    "threshold double, max_tags int, reviewed_examples long, mean_predicted_tags double, exact_match_accuracy double, "
    "mean_jaccard double, hamming_loss double, primary_accuracy double, micro_precision double, micro_recall double, "
    "micro_f1 double, macro_precision double, macro_recall double, macro_f1 double"
)


def read_sweep_csv(spark: SparkSession, path: str) -> DataFrame:
    """The sweep CSV with its required columns."""
    df = spark.read.option("header", True).schema(SWEEP_CSV_SCHEMA).csv(path)
    return require_columns(df, ["threshold", "max_tags", "micro_f1", "macro_f1", "mean_jaccard"], path)


def read_cluster_summary(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """A cluster summary, required ``cluster`` and ``members``, sorted by
    cluster: JSON lines, or with ``document`` one list of records per file
    (which may run over several lines)."""
    df = spark.read.option("multiLine", document).option("mode", "FAILFAST").json(path)
    return require_columns(df, ["cluster", "members"], path).orderBy("cluster")


def read_subcluster_sizes(spark: SparkSession, root: str, document: bool = False) -> DataFrame:
    """Every ``cluster_<N>/cluster_summary`` under ``root``; the parent
    id comes from the folder name (other folders are skipped), label
    ``"N.M"``, a missing fraction becomes 0.0."""
    reader = spark.read.option("multiLine", document).option("mode", "FAILFAST")
    df = reader.json(f"{root.rstrip('/')}/cluster_*/cluster_summary{{,.json,.jsonl}}")
    top = F.regexp_extract(F.col("_metadata.file_path"), r"/cluster_([0-9]+)/cluster_summary[^/]*(/[^/]+)?$", 1)
    frac = F.col("fraction").cast("double") if "fraction" in df.columns else F.lit(None).cast("double")
    out = df.select(
        F.when(top != "", top.cast("int")).alias("top_cluster"),
        F.col("cluster").cast("int").alias("subcluster"),
        F.col("members").cast("long").alias("members"),
        F.coalesce(frac, F.lit(0.0)).alias("fraction"),
    ).where(F.col("top_cluster").isNotNull())
    out = out.withColumn("label", F.concat_ws(".", F.col("top_cluster").cast("string"), F.col("subcluster").cast("string")))
    if out.isEmpty():
        raise InputError(f"no subcluster summaries found under {root}")
    return out.orderBy("top_cluster", "subcluster")


__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
