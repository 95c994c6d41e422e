"""Input layouts and guards that once failed silently."""

from __future__ import annotations

import json

import pytest

from tagwright.sources import readers as rd


def test_prediction_document_and_lines(spark, tmp_path):
    record = {
        "metadata": {"source_split": "test", "source_row": 3, "response_index": 0, "prompt_id": "p"},
        "response_preview": "x", "predicted_tags": ["a"], "top_tags": [{"tag": "a", "score": 0.5}],
    }
    document = tmp_path / "predictions.json"
    document.write_text(json.dumps({"algorithm": "svm", "results": [record, record]}, indent=2))
    rows = rd.read_prediction_document(spark, str(document)).collect()
    assert [(r["source_row"], r["predicted_tags"], r["pos"]["row"]) for r in rows] == [(3, ["a"], 0), (3, ["a"], 1)]
    with pytest.raises(Exception):
        rd.read_prediction_lines(spark, str(document)).collect()


def test_cluster_summary_layouts(spark, tmp_path):
    records = [{"cluster": c, "members": c + 1, "fraction": 0.5} for c in range(3)]
    lines = tmp_path / "cluster_summary.json"
    lines.write_text("\n".join(json.dumps(r) for r in records))
    assert rd.read_cluster_summary(spark, str(lines)).count() == 3
    folder = tmp_path / "runs" / "cluster_2"
    folder.mkdir(parents=True)
    (folder / "cluster_summary.json").write_text(json.dumps(records, indent=2))
    (folder / "cluster_summary.md").write_text("# Report\n\n| cluster | members |\n")
    assert rd.read_cluster_summary(spark, str(folder / "cluster_summary.json"), document=True).count() == 3
    sizes = rd.read_subcluster_sizes(spark, str(tmp_path / "runs"), document=True).collect()
    assert [(r["label"], r["members"]) for r in sizes] == [("2.0", 1), ("2.1", 2), ("2.2", 3)]


def test_prior_cluster_guards(spark):
    keys = "source_split string, source_row int, response_index int"
    prior = spark.createDataFrame([("a", 1, 0, 7)], f"{keys}, cluster int")
    with pytest.raises(rd.InputError):
        rd.filter_to_prior_cluster(prior.drop("cluster"), prior, 99)
    with pytest.raises(rd.InputError):
        rd.filter_to_prior_cluster(spark.createDataFrame([("b", 1, 0)], keys), prior, 7)


def test_checkpoint_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from tagwright.session import ensure_checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session)
