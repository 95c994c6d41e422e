"""The README walkthrough end to end on the driver tables (sf0.001)."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from tagwright.functions import text
from tagwright.operators import cluster, embed, evaluate, profile, responses, scale, split, sweep, tagger
from tagwright.operators.classifier import train_tagger
from tagwright.plans.tag_matrix import TAG_MATRIX_MD
from tagwright.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_reference_workflow(spark):
    out = tempfile.mkdtemp(prefix="workflow-", dir=os.path.dirname(spark.conf.get("spark.checkpoint.dir")))
    conv = spark.read.parquet(f"{SF}/conversations.parquet")

    # 1. split + flatten + embed
    split_col, sizes = split.split_assignment(conv, "conv_id")
    resp = responses.responses_from_flat(conv, split_col)
    resp = embed.with_hashed_embedding(resp.withColumn("rid", F.xxhash64("source_row", "response_index")), "rid")
    counts = {r[0]: r[1] for r in sinks.write_splits(resp, os.path.join(out, "responses")).collect()}
    assert sum(counts.values()) == resp.count() > 0

    # 2. cluster with combined features, profile
    feats = resp.select("*", *text.cluster_feature_columns("assistant_output"))
    feats = feats.select("*", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    n = feats.count()
    pca = scale.fit_pca(feats, [f"e{i}" for i in range(64)], 50)
    assert pca is not None and pca.components.shape[0] == min(50, n - 1)
    feats = scale.feature_mode(feats, "combined", [f"e{i}" for i in range(64)], text.CLUSTER_FEATURES)
    labelled, facts = cluster.kmeans(feats, "features", k=4)
    summary = profile.cluster_profile(labelled)
    assert summary.agg(F.sum("members")).first()[0] == resp.count()

    # 3-4. weak labels from the tag matrix, train, tag new responses
    tm_path = os.path.join(out, "tags.md")
    with open(tm_path, "w") as f:
        f.write(TAG_MATRIX_MD)
    tm = readers.parse_tag_matrix(readers.lines_of(spark, tm_path))
    for top in range(2):
        part = labelled.where(F.col("cluster") % 2 == top).select("assistant_output", F.lit(0).alias("cluster"))
        sinks.write_parquet(part, os.path.join(out, "subclusters", f"cluster_{top}", "clustered_responses.parquet"))
    train = readers.subcluster_training_scan(spark, os.path.join(out, "subclusters"))
    weak = text.with_classifier_features(tagger.weak_labels(train, tm))
    model = train_tagger(weak)
    assert len(model.tags) >= 2
    jl = os.path.join(out, "new.jsonl")
    rows = resp.select("source_split", "source_row", "response_index", "prompt_id", "assistant_output").collect()
    with open(jl, "w") as f:
        for r in rows:
            f.write(json.dumps({"response": r["assistant_output"], "source_split": r["source_split"], "source_row": r["source_row"],
                                "response_index": r["response_index"], "prompt_id": r["prompt_id"]}) + "\n")
    new = text.with_classifier_features(readers.read_jsonl_responses(spark, jl), text="response")
    preds = tagger.classify(new, model.scores(), threshold=-0.5, max_predicted_tags=5, text_col="response")
    assert preds.where(F.size("predicted_tags") == 0).count() == 0  # top-1 fallback
    recs = preds.select(
        F.col("metadata"), "response_preview", "predicted_tags", "top_tags"
    )
    sinks.write_json_lines(recs, os.path.join(out, "predictions"))

    # 5. reviewed labels, evaluation, sweep
    entries = [
        {"id": f"r{i}", "metadata": {"source_split": r["source_split"], "source_row": r["source_row"],
                                     "response_index": r["response_index"], "prompt_id": r["prompt_id"]},
         "true_tags": model.tags[: 1 + i % 2], "review_status": "reviewed", "assistant_output": r["assistant_output"]}
        for i, r in enumerate(rows)
    ]
    lp = os.path.join(out, "labels.json")
    with open(lp, "w") as f:
        json.dump({"entries": entries}, f)
    labels = evaluate.reviewed_only(readers.read_label_entries(spark, lp))
    pf = evaluate.latest_predictions(readers.read_prediction_lines(spark, os.path.join(out, "predictions")))
    m = evaluate.match_labels(labels, pf)
    u = evaluate.universe_eval(m, pf)
    o = evaluate.overall(m, u.count()).first()
    assert o["reviewed_examples"] == len(rows)
    results = sweep.rank_settings(sweep.sweep(m, sweep.universe_sweep(m, pf).count()), "micro_f1")
    assert results.count() == 60
