"""Invariants of the ML operators: the squared-hinge fit against a numpy
brute-force optimum (FIXTURES F9), constant tags, PCA, standardisation, unit
norm of embeddings, k-means."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.operators.classifier import fit_squared_hinge, gradient_norms, train_tagger
from tagwright.operators.scale import Standardizer, fit_pca


def _gaussian(spark, n=400, d=6, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y1 = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.7, size=n) > 0.3).astype(int)
    y2 = (x[:, 2] - x[:, 3] + rng.normal(scale=0.5, size=n) > 1.0).astype(int)
    rows = [tuple(map(float, x[i])) + (int(y1[i]), int(y2[i])) for i in range(n)]
    schema = ", ".join(f"z{j} double" for j in range(d)) + ", y0 int, y1 int"
    return spark.createDataFrame(rows, schema), x, np.c_[y1, y2]


def _numpy_optimum(x, y, cw, iters=60):
    n, d = x.shape
    xa = np.c_[x, np.ones(n)]
    w = np.zeros(d + 1)
    yy = 2 * y - 1
    c = np.where(yy > 0, cw[0], cw[1])
    for _ in range(iters):
        m = xa @ w
        act = 1 - yy * m > 0
        g = w + 2 * ((c[act] * (m[act] - yy[act])) @ xa[act])
        h = np.eye(d + 1) + 2 * (xa[act].T * c[act]) @ xa[act]
        w = w - np.linalg.solve(h, g)
    return w


def test_squared_hinge_matches_bruteforce(spark):
    df, x, y = _gaussian(spark)
    n = len(x)
    cw = np.array([[n / (2 * y[:, k].sum()), n / (2 * (n - y[:, k].sum()))] for k in range(2)])
    w, rounds = fit_squared_hinge(df, 2, cw, x.shape[1])
    assert rounds <= 30
    for k in range(2):
        ref = _numpy_optimum(x, y[:, k], cw[k])
        assert np.allclose(w[k], ref, atol=1e-7), (w[k], ref)
    assert gradient_norms(df, w, cw, x.shape[1]).max() < 1e-6


def test_fits_tell_whether_they_settled(spark):
    import warnings

    import pytest

    from tagwright.operators import cluster as cl
    from tagwright.operators.classifier import ConvergenceWarning

    df, x, _ = _gaussian(spark)
    cw = np.ones((2, 2))
    with pytest.warns(ConvergenceWarning, match="2 of 2 tags"):
        fit_squared_hinge(df, 2, cw, x.shape[1], max_iter=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error", ConvergenceWarning)
        fit_squared_hinge(df, 2, cw, x.shape[1])
    points = spark.createDataFrame([([float(i % 2 * 100 + i % 5)],) for i in range(100)], "v array<double>")
    facts = cl.kmeans(points, "v", k=2)[1]
    assert facts["converged"] and facts["rounds"] < 20
    assert cl.kmeans(points, "v", k=2, max_iter=1)[1]["converged"] is False


def test_constant_tag_scores_one(spark):
    rows = [(float(i % 5), float(i % 3), ["always", "odd"] if i % 2 else ["always"]) for i in range(60)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, tags array<string>")
    m = train_tagger(df, features=["f0", "f1"])
    k = m.tags.index("always")
    assert m.intercepts[k] == 1.0 and m.weights[k] == [0.0, 0.0]
    out = df.select(m.scores().alias("s")).first()["s"]
    assert {r["tag"]: r["score"] for r in out}["always"] == 1.0


def test_standardizer_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    st = Standardizer.fit(df, ["a", "b"])
    assert st.scale[0] == pytest.approx(np.std([1, 2, 4]))
    z = [r[0] for r in st.transform(df).select("z_b").collect()]
    assert z == [0.0, 0.0, 0.0]


def test_pca_invariants(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    wide = emb.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    m = fit_pca(wide, [f"e{i}" for i in range(64)], 5)
    assert np.allclose(m.components @ m.components.T, np.eye(5), atol=1e-8)
    r = m.explained_variance_ratio
    assert np.all(np.diff(r) <= 1e-12) and 0 < r.sum() <= 1
    proj = m.project(wide).select(*[F.avg(f"pc{k}") for k in range(5)]).first()
    assert np.allclose(list(proj), 0, atol=1e-9)  # centred
    x = np.array(wide.collect())
    xc = x - x.mean(0)
    vals = np.linalg.eigvalsh(np.cov(xc.T))[::-1]
    assert np.allclose(r, vals[:5] / vals.sum(), atol=1e-8)
    assert fit_pca(wide, [f"e{i}" for i in range(64)], 64) is None


def test_hashed_embedding_unit_norm(spark):
    from tagwright.operators.embed import unit_norm_violations, with_hashed_embedding

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    e = with_hashed_embedding(docs, "doc_id", "text")
    assert e.count() == docs.count()
    assert unit_norm_violations(e) == 0


def test_hashed_embedding_whole_vectors(spark):
    import hashlib
    import re

    from tagwright.operators.embed import with_hashed_embedding
    from tagwright.session import ship_package

    ship_package(spark)
    texts = [None, "", "...", "One two, one!", "Été été 日本 x_y 12", "same", "same", "word " * 5000]
    rows = [(i if i != 3 else None, t, "kept") for i, t in enumerate(texts)] + [(5, "repeated key", "kept")]
    df = spark.createDataFrame(rows, "k long, text string, other string")
    out = with_hashed_embedding(df, "k", "text", 16)
    assert out.columns == ["k", "text", "other", "embedding"]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert sorted(((r["k"], r["text"], r["other"]) for r in got), key=str) == sorted(rows, key=str)
    for r in got:
        v = np.zeros(16)
        for token in re.findall(r"\w+", (r["text"] or "").lower()):
            digest = hashlib.md5(token.encode()).hexdigest()
            v[int(digest[:8], 16) % 16] += 1 if int(digest[8], 16) < 8 else -1
        norm = np.sqrt((v * v).sum())
        assert np.array_equal(np.array(r["embedding"], np.float32), (v / norm if norm else v).astype(np.float32))


def test_kmeans_and_grouped(spark):
    from tagwright.operators import cluster as cl

    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out, facts = cl.kmeans(emb, "embedding", k=4)
    assert facts["cluster_count"] == 4 and facts["inertia"] > 0
    g = cl.grouped_kmeans(emb, "label", "vec_id", "embedding", k=2, iterations=3)
    sizes = dict(((r["label"]), r["n"]) for r in g.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes == dict((r["label"], r["count"]) for r in emb.groupBy("label").count().collect())


def _char_encoder():
    def encode(texts):
        out = np.zeros((len(texts), 8))
        for i, t in enumerate(texts):
            for ch in t:
                out[i, ord(ch) % 8] += 1.0
        return out

    return encode


def test_embed_with_custom_encoder_and_manifest(spark):
    import json
    import os
    import tempfile

    from tagwright.operators.embed import embed_with, unit_norm_violations
    from tagwright.sources.sinks import write_manifest

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("assistant_output"))
    e = embed_with(docs, _char_encoder)
    assert e.count() == docs.count() and unit_norm_violations(e) == 0
    row = e.orderBy("doc_id").first()
    want = _char_encoder()([row["assistant_output"]])[0]
    assert np.allclose(np.array(row["embedding"]), want / np.linalg.norm(want), atol=1e-6)
    out = tempfile.mkdtemp(prefix="manifest-", dir=os.path.dirname(spark.conf.get("spark.checkpoint.dir")))
    write_manifest(spark, {"responses": e.count(), "embedding_shape": [e.count(), 8]}, os.path.join(out, "m"))
    text = "".join(open(os.path.join(out, "m", f)).read() for f in sorted(os.listdir(os.path.join(out, "m"))) if f.startswith("part-"))
    assert json.loads(text)["embedding_shape"] == [docs.count(), 8]


def test_percentiles_match_numpy(spark):
    import numpy as np

    from tagwright.operators.quantile import exact_percentiles, grouped_medians

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=3000), np.full(900, 0.25), [1e300, -1e300, 1e-300, 5e-324]])
    y = rng.integers(0, 5, len(x)).astype(float)
    rows = [(int(i % 3), float(a), float(b), None) for i, (a, b) in enumerate(zip(x, y))] + [(0, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double").repartition(6)
    shares = [0.0, 0.01, 0.05, 0.5, 0.731, 0.99, 1.0]
    wanted = [(c, q) for c in ("x", "y") for q in shares] + [("z", 0.5)]
    for few in (5, 4096):
        got = exact_percentiles(df, wanted, parts=16, few=few)
        assert got[-1] is None
        assert np.allclose(got[:7], np.percentile(x, [100 * q for q in shares]), rtol=1e-12)
        assert np.allclose(got[7:14], np.percentile(y, [100 * q for q in shares]))
    med = {r["g"]: r["y"] for r in grouped_medians(df, "g", ["y"]).collect()}
    assert med == {g: np.median(y[np.arange(len(y)) % 3 == g]) for g in range(3)}
