"""Readers: tag matrix quirks (F6), response files (F7), labels (S14),
responses from nested conversations (F1)."""

from __future__ import annotations

import json
import os
import tempfile

import pytest

from tagwright.plans.tag_matrix import TAG_MATRIX_MD, TAG_MATRIX_ROWS
from tagwright.sources import readers as rd


@pytest.fixture()
def tmp(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    d = tempfile.mkdtemp(prefix="readers-", dir=os.path.dirname(base))
    return d


def test_tag_matrix_quirks(spark):
    got = rd.parse_tag_matrix(rd.lines_from_text(spark, TAG_MATRIX_MD))
    rows = sorted((r["top_cluster"], r["subcluster"], list(r["tags"])) for r in got.collect())
    assert rows == sorted(TAG_MATRIX_ROWS)


def test_tag_matrix_from_file_and_empty(spark, tmp):
    p = os.path.join(tmp, "tags.md")
    with open(p, "w") as f:
        f.write("| 0.1 | `a`, `b` | `b` | x |\r\n| 0.1 | `c` | | x |\n| 2.x | `z` | | |\n")
    got = rd.parse_tag_matrix(rd.lines_of(spark, p)).collect()
    assert [(r["top_cluster"], r["subcluster"], list(r["tags"])) for r in got] == [(0, 1, ["c"])]
    with pytest.raises(rd.InputError):
        rd.parse_tag_matrix(rd.lines_from_text(spark, "| Subcluster | a | b | c |\n"))


def test_jsonl_items(spark, tmp):
    p = os.path.join(tmp, "in.jsonl")
    lines = [
        json.dumps("plain string"),
        json.dumps({"response": "r1", "source_row": 3}),
        json.dumps({"assistant_output": "a1", "prompt_id": "p"}),
        json.dumps({"response": "r2", "assistant_output": "ignored"}),
        "",
    ]
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    got = rd.read_jsonl_responses(spark, p).orderBy("item_no").collect()
    assert [r["response"] for r in got] == ["plain string", "r1", "a1", "r2"]
    assert got[1]["metadata"] == {"source_row": "3"}
    assert got[3]["metadata"] == {}
    bad = os.path.join(tmp, "bad.jsonl")
    with open(bad, "w") as f:
        f.write(json.dumps({"response": None, "assistant_output": "x"}) + "\n" + "12\n")
    with pytest.raises(rd.InputError):
        rd.read_jsonl_responses(spark, bad)


def test_json_list_and_text(spark, tmp):
    p = os.path.join(tmp, "in.json")
    with open(p, "w") as f:
        json.dump(["s1", {"response": "s2", "k": "v"}], f)
    got = rd.read_json_list_responses(spark, p).orderBy("item_no").collect()
    assert [r["response"] for r in got] == ["s1", "s2"]
    obj = os.path.join(tmp, "obj.json")
    with open(obj, "w") as f:
        json.dump({"response": "x"}, f)
    with pytest.raises(rd.InputError):
        rd.read_json_list_responses(spark, obj)
    t = os.path.join(tmp, "in.txt")
    with open(t, "w") as f:
        f.write("first block\nstill first\n\n  \n second \n\n\n   \n")
    assert [r["response"] for r in rd.read_text_responses(spark, t).orderBy("item_no").collect()] == [
        "first block\nstill first",
        "second",
    ]


def test_labels_both_shapes(spark, tmp):
    e = {"id": "a", "metadata": {"source_split": "test", "source_row": 1, "response_index": 0, "prompt_id": "p"},
         "true_tags": ["x"], "review_status": "reviewed", "assistant_output": "hi"}
    p1, p2, p3 = (os.path.join(tmp, n) for n in ("l1.json", "l2.json", "l3.json"))
    json.dump([e], open(p1, "w"))
    json.dump({"entries": [e, e]}, open(p2, "w"))
    json.dump({"other": 1}, open(p3, "w"))
    assert rd.read_label_entries(spark, p1).count() == 1
    r = rd.read_label_entries(spark, p2).collect()
    assert len(r) == 2 and r[0]["source_row"] == 1 and r[0]["primary_tag"] is None
    with pytest.raises(rd.InputError):
        rd.read_label_entries(spark, p3)


def test_nested_conversations(spark):
    from tagwright.operators.responses import responses_from_nested

    rows = [
        ("p1", [("user", "Q1 "), ("assistant", "  A1\n"), ("assistant", " \n "), ("assistant", "A2")]),
        ("p2", [("assistant", "only answer"), ("user", "late question")]),
        ("p3", [("user", "q")]),
        ("p4", None),
        ("p5", [("assistant", None)]),
    ]
    df = spark.createDataFrame(
        [(i, p, m) for i, (p, m) in enumerate(rows)],
        "source_row long, prompt_id string, messages array<struct<role:string,content:string>>",
    )
    got = responses_from_nested(df, "train").orderBy("source_row", "response_index").collect()
    assert [(r["prompt_id"], r["response_index"], r["prompt"], r["assistant_output"]) for r in got] == [
        ("p1", 0, "Q1 ", "A1"),
        ("p1", 1, "Q1 ", "A2"),
        ("p2", 0, "late question", "only answer"),
        ("p5", 0, "", "None"),
    ]


def test_flat_and_nested_agree(spark):
    from pyspark.sql import functions as F

    from tagwright.operators.responses import responses_from_flat, responses_from_nested

    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    flat = responses_from_flat(conv, "train", block_turns=2)
    nested = conv.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
                    lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    ).select(F.col("conv_id").alias("source_row"), F.col("conv_id").cast("string").alias("prompt_id"), "messages")
    nested_r = responses_from_nested(nested, "train")
    a = sorted(map(tuple, flat.collect()))
    b = sorted(map(tuple, nested_r.collect()))
    assert a == b and len(a) > 0


def test_parquet_responses_and_load_order(spark, tmp):
    p = os.path.join(tmp, "resp.parquet")
    spark.createDataFrame(
        [("a1", "p1", 3, None), ("a2", None, 4, "x")], "assistant_output string, prompt_id string, source_row int, extra string"
    ).coalesce(1).write.parquet(p)
    got = rd.read_parquet_responses(spark, p).orderBy("item_no").collect()
    assert [r["response"] for r in got] == ["a1", "a2"]
    assert got[0]["metadata"] == {"prompt_id": "p1", "source_row": "3"}
    assert got[1]["metadata"] == {"source_row": "4", "extra": "x"}
    allr = rd.load_responses(spark, ["inline one", "inline two"], rd.read_parquet_responses(spark, p), max_responses=3)
    assert [r["response"] for r in allr.collect()] == ["inline one", "inline two", "a1"]
    with pytest.raises(rd.InputError):
        rd.load_responses(spark, [], None)


def test_prediction_file_round_trip(spark, tmp):
    from pyspark.sql import functions as F

    from tagwright.operators.evaluate import latest_predictions
    from tagwright.plans.q_eval import prediction_file
    from tagwright.sources.sinks import write_json_lines

    pf = prediction_file(spark, "/root/testdata/sf0.001").orderBy("pos")
    meta = F.create_map(
        F.lit("source_split"), F.col("source_split"), F.lit("source_row"), F.col("source_row").cast("string"),
        F.lit("response_index"), F.col("response_index").cast("string"), F.lit("prompt_id"), F.col("prompt_id"),
    )
    out = os.path.join(tmp, "preds")
    write_json_lines(pf.select(meta.alias("metadata"), F.lit("").alias("response_preview"), "predicted_tags", "top_tags").coalesce(1), out)
    back = latest_predictions(rd.read_prediction_lines(spark, out))
    want = latest_predictions(pf)
    a = sorted((r["source_row"], tuple(r["predicted_tags"])) for r in back.collect())
    b = sorted((r["source_row"], tuple(r["predicted_tags"])) for r in want.collect())
    assert a == b and len(a) == 500


def test_jsonl_multi_file_order_and_cap(spark, tmp):
    d = os.path.join(tmp, "many")
    os.makedirs(d)
    with open(os.path.join(d, "part-a.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(f"a{i}") for i in range(3)) + "\n")
    with open(os.path.join(d, "part-b.jsonl"), "w") as f:  # larger: Spark reads it first
        f.write("\n".join(json.dumps("b" * 200 + str(i)) for i in range(500)) + "\n")
    got = rd.load_responses(spark, ["inline"], rd.read_jsonl_responses(spark, d), max_responses=5)
    assert [r["response"][:4] for r in got.collect()] == ["inli", "a0", "a1", "a2", "bbbb"]
