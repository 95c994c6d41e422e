"""Writers and the readers of their output (K1, K5, K6, K10, K11 <-> S15,
S16, S17)."""

from __future__ import annotations

import glob
import os
import tempfile

from pyspark.sql import functions as F

from tagwright.operators import profile as pf
from tagwright.plans import derived as dv
from tagwright.sources import readers as rd
from tagwright.sources import sinks as sk


def _tmp(spark):
    base = os.path.dirname(spark.conf.get("spark.checkpoint.dir"))
    return tempfile.mkdtemp(prefix="sinks-", dir=base)


def test_cluster_outputs_round_trip(spark):
    out = _tmp(spark)
    cr = dv.clustered_responses(spark, "/root/testdata/sf0.001")
    summary = pf.cluster_profile(cr)
    # K5 + S16
    sk.write_json_lines(summary, os.path.join(out, "summary"))
    back = rd.read_cluster_summary(spark, os.path.join(out, "summary"))
    assert [r["cluster"] for r in back.collect()] == sorted(r["cluster"] for r in summary.collect())
    # S17 over cluster_<N>/cluster_summary folders (+ one folder that must be skipped)
    for top in (2, 5):
        sk.write_json_lines(summary.select("cluster", "members", "fraction"), os.path.join(out, f"cluster_{top}", "cluster_summary"))
    sk.write_json_lines(summary.select("cluster", "members"), os.path.join(out, "cluster_x", "cluster_summary"))
    subs = rd.read_subcluster_sizes(spark, out)
    assert {r["top_cluster"] for r in subs.collect()} == {2, 5}
    assert subs.count() == 2 * summary.count()
    # K6
    keys = ["source_split", "source_row", "response_index"]
    terms = pf.top_terms(cr, keys, limit=10)
    reps = pf.representatives(cr, "embedding", keys, limit=2)
    lines = sk.cluster_report_lines(summary, terms, reps.select("cluster", "rank", "assistant_output"))
    sk.write_cluster_report(lines, os.path.join(out, "report"))
    text = "".join(open(p).read() for p in sorted(glob.glob(os.path.join(out, "report", "part-*"))))
    assert text.startswith("# Cluster Summary\n\n## Cluster ")
    assert "- Fraction: " in text and "Sample 1: " in text


def test_split_and_sweep_outputs(spark):
    out = _tmp(spark)
    from tagwright.plans import q_eval, q_text

    resp = q_text.marked_responses(spark, "/root/testdata/sf0.001")
    counts = {r[0]: r[1] for r in sk.write_splits(resp, os.path.join(out, "splits")).collect()}
    back = spark.read.parquet(os.path.join(out, "splits"))
    assert {r[0]: r[1] for r in back.groupBy("source_split").count().collect()} == counts
    sweep = q_eval._sweep(spark, "/root/testdata/sf0.001")
    sk.write_sweep(sweep, os.path.join(out, "sweep_csv"), os.path.join(out, "sweep_json"))
    csv = rd.read_sweep_csv(spark, os.path.join(out, "sweep_csv"))
    assert csv.count() == 60
    best = csv.first()
    assert best["micro_f1"] == sweep.where(F.col("rank") == 1).first()["micro_f1"]
    m, _ = q_eval.matched(spark, "/root/testdata/sf0.001")
    from tagwright.operators.evaluate import disagreements

    sk.write_disagreements(disagreements(m), os.path.join(out, "dis"))
    dis = spark.read.option("header", True).csv(os.path.join(out, "dis"))
    assert dis.columns == ["id", "source_row", "response_index", "true_tags", "predicted_tags", "missing_tags", "extra_tags", "assistant_preview"]


def test_embedding_split_and_subcluster_scan(spark):
    out = _tmp(spark)
    cr = dv.clustered_responses(spark, "/root/testdata/sf0.001")
    keys = ["source_split", "source_row", "response_index"]
    # S3: metadata and vectors in separate keyed tables must match both ways
    sk.write_parquet(cr.drop("embedding"), os.path.join(out, "meta"))
    sk.write_parquet(cr.select(*keys, "embedding"), os.path.join(out, "vec"))
    both = rd.load_embedding_split(spark, os.path.join(out, "meta"), os.path.join(out, "vec"))
    assert both.count() == cr.count()
    sk.write_parquet(cr.select(*keys, "embedding").limit(3), os.path.join(out, "vec_short"))
    import pytest

    with pytest.raises(rd.InputError):
        rd.load_embedding_split(spark, os.path.join(out, "meta"), os.path.join(out, "vec_short"))
    # One scan over cluster_<top>/clustered_responses.parquet folders
    for top in (1, 4):
        part = cr.where(F.col("cluster") % 5 == top).select("assistant_output", F.floor(F.col("cluster") / 5).cast("int").alias("cluster"))
        sk.write_parquet(part, os.path.join(out, "subs", f"cluster_{top}", "clustered_responses.parquet"))
    scan = rd.subcluster_training_scan(spark, os.path.join(out, "subs"))
    got = {(r["top_cluster"], r["cluster"]): r["n"] for r in scan.groupBy("top_cluster", "cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {(top, c // 5): n for (c, n) in ((r["cluster"], r["count"]) for r in cr.groupBy("cluster").count().collect()) for top in (1, 4) if c % 5 == top}
    assert got == want


def test_prediction_records_and_evaluation_parts(spark):
    import json

    from tagwright.functions.text import CLASSIFIER_FEATURES, with_classifier_features
    from tagwright.operators import evaluate as ev
    from tagwright.operators.tagger import LinearTagModel, classify, prediction_records
    from tagwright.plans import q_eval, q_text

    out = _tmp(spark)
    model = LinearTagModel(["a", "b"], [[0.5] + [0.0] * 19, [0.0, 1.0] + [0.0] * 18], [0.0, -1.0], [0.0] * 20, [1.0] * 20)
    resp = with_classifier_features(q_text.marked_responses(spark, "/root/testdata/sf0.001"))
    keys = ["source_split", "source_row", "response_index", "prompt_id"]
    recs = prediction_records(classify(resp, model.scores(), -0.5, 5, 5), keys, CLASSIFIER_FEATURES)
    sk.write_json_lines(recs, os.path.join(out, "preds"))
    back = rd.read_prediction_lines(spark, os.path.join(out, "preds"))
    assert back.count() == resp.count()
    first = json.loads(open(sorted(glob.glob(os.path.join(out, "preds", "part-*.json")))[0]).readline())
    assert set(first) == {"metadata", "response_preview", "predicted_tags", "top_tags", "feature_names", "features"}
    assert len(first["features"]) == 20
    m, preds = q_eval.matched(spark, "/root/testdata/sf0.001")
    u = ev.universe_eval(m, preds)
    parts = {"overall": ev.overall(m, u.count()), "per_tag": ev.per_tag(m, u), "confusion_pairs": ev.confusion_pairs(m)}
    sk.write_evaluation(parts, os.path.join(out, "metrics"))
    assert spark.read.json(os.path.join(out, "metrics", "overall")).count() == 1
    assert spark.read.json(os.path.join(out, "metrics", "per_tag")).count() == u.count()


def test_profile_approx_median_close_to_exact(spark):
    cr = dv.clustered_responses(spark, "/root/testdata/sf0.01")
    exact = {r["cluster"]: r["median_chars"] for r in pf.cluster_profile(cr).collect()}
    approx = {r["cluster"]: r["median_chars"] for r in pf.cluster_profile(cr, approx_median=True).collect()}
    assert exact.keys() == approx.keys()
    for c in exact:
        assert abs(exact[c] - approx[c]) <= 0.02 * exact[c] + 1
