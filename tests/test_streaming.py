"""The streaming tagger gives the same rows as the batch tagger."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from tagwright.operators.tagger import LinearTagModel, classify
from tagwright.functions.text import CLASSIFIER_FEATURES, with_classifier_features
from tagwright.plans.q_text import marked_responses
from tagwright.streaming.tagging import read_response_stream, start_tagging, tag_stream

MODEL = LinearTagModel(
    tags=["hedged", "listy", "polite"],
    weights=[[0.0] * 15 + [3.0] + [0.0] * 4, [0.0] * 6 + [2.0, 1.0] + [0.0] * 12, [0.0] * 11 + [1.5] + [0.0] * 8],
    intercepts=[-0.5, -0.25, -0.75],
    mean=[0.0] * 20,
    scale=[1.0] * 20,
)


def test_stream_equals_batch(spark):
    base = os.path.dirname(spark.conf.get("spark.checkpoint.dir"))
    work = tempfile.mkdtemp(prefix="stream-", dir=base)
    src, sink = os.path.join(work, "in"), os.path.join(work, "out")
    resp = marked_responses(spark, "/root/testdata/sf0.001").select(
        "source_split", "source_row", "response_index", "prompt_id", "assistant_output"
    )
    resp.repartition(3).write.parquet(src)
    q = start_tagging(tag_stream(read_response_stream(spark, src), MODEL), sink, name=f"t{os.getpid()}", available_now=True)
    q.awaitTermination(180)
    got = spark.read.parquet(sink).select("source_row", "response_index", F.array_join("predicted_tags", ",").alias("p"))
    want = classify(with_classifier_features(resp), MODEL.scores(), -0.5, 5, 5).select(
        "source_row", "response_index", F.array_join("predicted_tags", ",").alias("p")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(CLASSIFIER_FEATURES) == 20
