"""Training-set builder: caps, labels, guards and odd rows."""

from __future__ import annotations

import hashlib

import pytest

from tagwright.operators.training import training_counts, training_set
from tagwright.sources import readers as rd

MATRIX = [(0, 0, ["a", "b"]), (0, 1, ["c"]), (3, 2, ["a"]), (7, 0, ["z"])]
SCHEMA = "source_split string, source_row long, response_index long, assistant_output string, top_cluster int, cluster int, tags string"


def _rows():
    out = [("train", i, 0, f"text {i}", 0, 0, "old") for i in range(300)]  # the hot subcluster
    out += [("train", 1000 + i, 0, None if i else "", 0, 1, "old") for i in range(3)]
    out += [("train", 2000 + i, 0, "x", 3, 2, "old") for i in range(12)]
    out += [("train", 3000, 0, "no tags", 5, 5, "old"), ("train", 3001, 0, "null", None, 0, "old"), (None, None, None, "k", 0, 1, "old")]
    return out


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame(MATRIX, "top_cluster int, subcluster int, tags array<string>")


def test_members_are_capped_by_hash_and_get_all_tags(spark, matrix):
    got = training_set(spark.createDataFrame(_rows(), SCHEMA), matrix, cap=12, seed=9).collect()

    def place(r):
        key = "\x1f".join("" if v is None else str(v) for v in r[:3])
        return hashlib.md5(f"9:{key}".encode()).hexdigest()

    want = set()
    for top, sub, tags in MATRIX:
        members = sorted((r for r in _rows() if r[4] == top and r[5] == sub), key=place)
        want |= {(*r[:6], tuple(tags)) for r in members[:12]}
    assert {(r["source_split"], r["source_row"], r["response_index"], r["assistant_output"], r["top_cluster"], r["cluster"],
             tuple(r["tags"])) for r in got} == want
    assert len(got) == len(want)


def test_without_a_cap_all_members_stay_and_are_counted(spark, matrix):
    train = training_set(spark.createDataFrame(_rows(), SCHEMA), matrix)
    counts = {(r["top_cluster"], r["subcluster"]): (r["rows"], r["n_tags"]) for r in training_counts(train, matrix).collect()}
    assert counts == {(0, 0): (300, 2), (0, 1): (4, 1), (3, 2): (12, 1), (7, 0): (0, 1)}


def test_guards(spark, matrix, tmp_path):
    df = spark.createDataFrame(_rows(), SCHEMA)
    with pytest.raises(rd.InputError, match="missing columns"):
        training_set(df.drop("source_row"), matrix)
    with pytest.raises(rd.InputError, match="names no subcluster"):
        training_set(df, matrix.limit(0))
    with pytest.raises(rd.InputError, match="no response"):
        training_set(df.where("top_cluster = 5"), matrix)
    with pytest.raises(rd.InputError, match="no response"):
        training_set(df.limit(0), matrix, cap=3)
    with pytest.raises(rd.InputError, match="holds no cluster"):
        rd.subcluster_training_scan(spark, str(tmp_path))
