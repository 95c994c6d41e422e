"""Evaluation quirks (FIXTURES F8), hand-computed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tagwright.operators import evaluate as ev
from tagwright.operators import sweep as sw

LAB = "id string, source_split string, source_row long, response_index long, prompt_id string, true_tags array<string>, primary_tag string, review_status string, assistant_output string, pos long"
PRED = "source_split string, source_row long, response_index long, prompt_id string, predicted_tags array<string>, top_tags array<struct<tag:string,score:double>>, pos long"


def _frames(spark):
    labels = spark.createDataFrame(
        [
            ("a", "t", 1, 0, None, [], None, "reviewed", "x\ny", 0),  # both empty; null prompt_id on both sides
            ("b", "t", 2, 0, "p2", ["x", "x", "y"], "", "reviewed", "b", 1),  # duplicate tag, empty primary
            ("c", "t", 3, 0, "p3", ["y"], "x", "reviewed", "c", 2),
            ("c2", "t", 3, 0, "p3", ["y"], None, "reviewed", "c", 3),  # duplicate label key: both count
            ("u", "t", 9, 0, "p9", ["z"], None, "pending", "u", 4),  # unreviewed, no prediction
        ],
        LAB,
    )
    preds = spark.createDataFrame(
        [
            ("t", 1, 0, None, [], [], 0),
            ("t", 2, 0, "p2", ["q"], [("q", 1.0)], 1),
            ("t", 2, 0, "p2", ["x", "y", "y"], [("x", 0.5), ("y", 0.25)], 2),  # later duplicate wins
            ("t", 3, 0, "p3", ["x"], None, 3),  # missing top_tags
        ],
        PRED,
    )
    return labels, preds


def test_matching_and_metrics(spark):
    labels, preds = _frames(spark)
    latest = ev.latest_predictions(preds)
    rev = ev.reviewed_only(labels)
    m = ev.match_labels(rev, latest)
    assert m.count() == 4
    u = ev.universe_eval(m, latest)
    assert sorted(r[0] for r in u.collect()) == ["x", "y"]
    o = ev.overall(m, 2).first()
    # rows: a {}/{} -> exact 1, jaccard 0; b {x,y}/{x,y} exact; c,c2 {y}/{x} wrong
    assert o["exact_match_accuracy"] == pytest.approx(0.5)
    assert o["mean_jaccard"] == pytest.approx(0.25)
    assert o["hamming_loss"] == pytest.approx(4 / 8)
    assert o["micro_precision"] == pytest.approx(2 / 4)
    assert o["micro_recall"] == pytest.approx(2 / 4)
    pt = {r["tag"]: r for r in ev.per_tag(m, u).collect()}
    assert (pt["x"]["tp"], pt["x"]["fp"], pt["x"]["fn"], pt["x"]["tn"]) == (1, 2, 0, 1)
    assert (pt["y"]["tp"], pt["y"]["fp"], pt["y"]["fn"], pt["y"]["tn"]) == (1, 0, 2, 1)


def test_unmatched_label_aborts(spark):
    labels, preds = _frames(spark)
    with pytest.raises(ValueError, match="did not match"):
        ev.match_labels(labels, ev.latest_predictions(preds))


def test_primary_confusion_and_sweep_primary(spark):
    labels, preds = _frames(spark)
    latest = ev.latest_predictions(preds)
    m = ev.match_labels(ev.reviewed_only(labels), latest)
    conf = {(r["true_tag"], r["predicted_tag"]): r["n"] for r in ev.primary_confusion(m, ev.universe_eval(m, latest)).collect()}
    # a: no true primary and no prediction -> left out; b: '' falls through to 'x', predicted 'x'
    # c: primary 'x' vs 'x'; c2: first true 'y' vs 'x'
    assert conf == {("x", "x"): 2, ("y", "x"): 1}
    acc = ev.primary_accuracy(ev.primary_confusion(m, ev.universe_eval(m, latest))).first()
    assert acc["accuracy"] == pytest.approx(2 / 3) and acc["total"] == 3
    res = sw.sweep(m, 2, thresholds=[0.0], caps=[1]).first()
    # sweep counts every row with a true primary (3 rows), a excluded (no true tags)
    # re-ranked: a -> [] ; b -> x(0.5),y ; c -> x (score 0.0 from predicted_tags)
    assert res["primary_accuracy"] == pytest.approx(2 / 3)
    assert res["mean_predicted_tags"] == pytest.approx(3 / 4)


def test_allow_empty_and_inclusive_threshold(spark):
    labels, preds = _frames(spark)
    latest = ev.latest_predictions(preds)
    m = ev.match_labels(ev.reviewed_only(labels), latest)
    strict = {r["threshold"]: r["mean_predicted_tags"] for r in sw.sweep(m, 2, thresholds=[0.5, 5.0], caps=[5], allow_empty=True).collect()}
    assert strict[0.5] == pytest.approx(1 / 4)  # b keeps x (0.5 >= 0.5), nobody else
    assert strict[5.0] == 0.0
    fallback = {r["threshold"]: r["mean_predicted_tags"] for r in sw.sweep(m, 2, thresholds=[5.0], caps=[5]).collect()}
    assert fallback[5.0] == pytest.approx(3 / 4)  # top-1 for every row with a ranking


def test_pairs_and_disagreements(spark):
    labels, preds = _frames(spark)
    m = ev.match_labels(ev.reviewed_only(labels), ev.latest_predictions(preds))
    pairs = [(r["pair"], r["count"]) for r in ev.confusion_pairs(m).collect()]
    assert pairs == [("y -> x", 2)]
    d = ev.disagreements(m).orderBy("id").collect()
    assert [r["id"] for r in d] == ["c", "c2"]
    assert d[0]["missing_tags"] == "y" and d[0]["extra_tags"] == "x"


def test_primary_for_labels(spark):
    df = spark.createDataFrame([(["b", "a"],), (["zz"],), (["a", "c"],)], "tags array<string>")
    col = ev.primary_for_labels(F.col("tags"), ["a", "b", "c"], {"a": 3, "b": 3, "c": 5})
    assert [r[0] for r in df.select(col).collect()] == ["a", "unlabeled", "c"]


def test_sweep_helpers(spark):
    rows = [(i, t, c, f) for i, (t, c, f) in enumerate([(0.0, 1, 0.5), (0.0, 2, 0.5), (0.5, 1, 0.25), (0.5, 2, 0.75)])]
    res = spark.createDataFrame(rows, "setting_pos int, threshold double, max_tags int, micro_f1 double")
    best = {r["threshold"]: r["max_tags"] for r in sw.best_per_threshold(res).collect()}
    assert best == {0.0: 1, 0.5: 2}  # ties go to the smaller cap
    with pytest.raises(ValueError):
        sw.check_metric("accuracy")
    assert sw.check_metric("macro_f1") == "macro_f1"
    curve = [(r["max_tags"], r["threshold"]) for r in sw.f1_curves(res).collect()]
    assert curve == [(1, 0.0), (1, 0.5), (2, 0.0), (2, 0.5)]


def test_tags_to_inspect(spark):
    pt = spark.createDataFrame([("a", 3, 0.5), ("b", 5, 0.1), ("c", 3, 0.9)], "tag string, support long, f1 double")
    assert ev.tags_to_inspect(pt, None, 2) == ["b", "c"]
    assert ev.tags_to_inspect(pt, ["z", "a", "b"], 2) == ["z", "a"]


def test_difference_sweep_matches_brute_force(spark):
    """Rankings with repeated tags, equal scores, scores on a threshold, none
    saved, no true tags; odd grids with repeated and unsorted values."""
    import random

    rng = random.Random(3)
    tags = ["a", "b", "c", "d"]
    rows = []
    for _ in range(120):
        true = rng.sample(tags, rng.randint(0, 3))
        ranked = [(rng.choice(tags), rng.choice([-1.0, 0.0, 0.5, 0.5, 2.0])) for _ in range(rng.randint(0, 5))]
        rows.append((true, rng.choice([None, "", "a"]), ranked, rng.sample(tags, rng.randint(0, 2))))
    m = spark.createDataFrame(rows, "true_tags array<string>, primary_tag string, p_top_tags array<struct<tag:string,score:double>>, p_predicted_tags array<string>")
    thresholds, caps = [0.5, -2.0, 0.0, 9.0, 0.5], [3, 1, 7]
    universe = spark.createDataFrame([(t,) for t in [*tags, "unused"]], "tag string")
    for allow_empty in (False, True):
        got = {r["setting_pos"]: r for r in sw.sweep(m, 5, thresholds, caps, allow_empty).collect()}
        per = {(r["setting_pos"], r["tag"]): r for r in sw.per_tag_by_setting(m, universe, thresholds, caps, allow_empty).collect()}
        assert len(got) == 15 and len(per) == 75
        for pos, (t, c) in enumerate((t, c) for t in thresholds for c in caps):
            n = dict.fromkeys(["pred", "exact", "jaccard", "hamming", "prim", "right"], 0.0)
            counts = {x: [0, 0, 0] for x in [*tags, "unused"]}
            for true, primary, ranked, predicted in rows:
                base = ranked or [(x, 0.0) for x in predicted]
                order = sorted(base, key=lambda x: -x[1])
                picked = [x for x, s in order if s >= t][:c]
                if not picked and order and not allow_empty:
                    picked = [order[0][0]]
                p, q = set(true), set(picked)
                n["pred"] += len(q)
                n["exact"] += p == q
                n["jaccard"] += len(p & q) / len(p | q) if p | q else 0.0
                n["hamming"] += len(p ^ q)
                first = primary or (true[0] if true else None)
                n["prim"] += first is not None
                n["right"] += first is not None and picked[:1] == [first]
                for x in counts:
                    counts[x][0] += x in p and x in q
                    counts[x][1] += x in q and x not in p
                    counts[x][2] += x in p and x not in q
            r = got[pos]
            assert (r["threshold"], r["max_tags"], r["reviewed_examples"]) == (t, c, 120)
            want = [n["pred"] / 120, n["exact"] / 120, n["jaccard"] / 120, n["hamming"] / 600, n["right"] / n["prim"]]
            assert [r[k] for k in ("mean_predicted_tags", "exact_match_accuracy", "mean_jaccard", "hamming_loss", "primary_accuracy")] == pytest.approx(want)
            for x, (tp, fp, fn) in counts.items():
                o = per[pos, x]
                assert (o["tp"], o["fp"], o["fn"], o["tn"]) == (tp, fp, fn, 120 - tp - fp - fn)
            tp, fp, fn = (sum(v[i] for v in counts.values()) for i in range(3))
            assert r["micro_precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0.0)
            assert r["micro_recall"] == pytest.approx(tp / (tp + fn))
            assert r["macro_recall"] == pytest.approx(sum(a / (a + z) if a + z else 0.0 for a, _, z in counts.values()) / 5)
    nested = sw.with_per_tag(sw.sweep(m, 5, thresholds, caps), sw.per_tag_by_setting(m, universe, thresholds, caps)).collect()
    assert all([x["tag"] for x in r["per_tag"]] == [*tags, "unused"] for r in nested)
