"""Tagging new responses as they arrive (Structured Streaming).

The reference tags finite files only.  Every step of tagging - the 20
behaviour features (X7) and scoring, ranking, thresholding (C6-C9) - is a
stateless per-row expression, so the same code runs unchanged on a stream:
append mode, no watermark and no state store needed.  Progress is kept in a
checkpoint under the cluster's shared ``spark.checkpoint.dir``, so a restarted
query resumes where it stopped.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import with_classifier_features
from ..operators.tagger import LinearTagModel, classify
from ..session import ensure_checkpoint_dir

RESPONSE_STREAM_SCHEMA = (
    "source_split string, source_row long, response_index long, prompt_id string, assistant_output string"
)


def read_response_stream(spark: SparkSession, path: str, schema: str = RESPONSE_STREAM_SCHEMA, fmt: str = "parquet") -> DataFrame:
    """New response files under ``path`` as a stream (explicit schema)."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", 64).load(path)


def tag_stream(
    stream: DataFrame,
    model: LinearTagModel,
    threshold: float = -0.5,
    max_predicted_tags: int = 5,
    n_top: int = 5,
    text_col: str = "assistant_output",
) -> DataFrame:
    """X7 + C6-C9 on a streaming frame (identical to the batch plan)."""
    feats = with_classifier_features(stream, text=text_col)
    out = classify(feats, model.scores(), threshold, max_predicted_tags, n_top, text_col=text_col)
    return out.drop(*model.features)


def start_tagging(
    tagged: DataFrame,
    sink_path: str,
    name: str = "tagging",
    fmt: str = "parquet",
    available_now: bool = False,
    processing_time: str | None = "30 seconds",
) -> StreamingQuery:
    """Write tagged rows in append mode; the checkpoint lives in the shared
    checkpoint folder (``<spark.checkpoint.dir>/streams/<name>``)."""
    base = ensure_checkpoint_dir(tagged.sparkSession)
    writer = (
        tagged.writeStream.format(fmt)
        .outputMode("append")
        .option("path", sink_path)
        .option("checkpointLocation", posixpath.join(base, "streams", name))
        .queryName(name)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
