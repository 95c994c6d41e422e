"""Queries for prediction (C6-C9), evaluation (S13, E1-E17) and the
threshold sweep (W1-W8) over the derived labels / scores (FIXTURES F5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import sweep as sw
from ..operators.tagger import classify
from . import derived as dv
from .registry import r6, register, s6

THR, MAXT, NTOP = -0.5, 5, 5
KEY4 = ev.KEY4
K4 = ", ".join(KEY4)


# ----------------------------------------------------------------------------
# Spark side
# ----------------------------------------------------------------------------

def predictions(spark: SparkSession, sf_dir: str, threshold: float = THR) -> DataFrame:
    sc = dv.prediction_scores(spark, sf_dir)
    return classify(sc, F.col("scores"), threshold, MAXT, NTOP, text_col=None).drop("scores")


def prediction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to one file: threshold 0.0 first, then -0.5; the
    later run must win for every key."""
    a = predictions(spark, sf_dir, 0.0).withColumn("pos", F.col("pos") * 2)
    b = predictions(spark, sf_dir, THR).withColumn("pos", F.col("pos") * 2 + 1)
    return a.unionByName(b)


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    preds = ev.latest_predictions(prediction_file(spark, sf_dir))
    labels = ev.reviewed_only(dv.label_entries(spark, sf_dir))
    return ev.match_labels(labels, preds), preds


def _per_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, preds = matched(spark, sf_dir)
    return ev.per_tag(m, ev.universe_eval(m, preds))


# ----------------------------------------------------------------------------
# DuckDB side
# ----------------------------------------------------------------------------

def _preds_sql(name: str, thr: float, pos: str) -> str:
    return f"""
    {name}_p0 AS (SELECT {K4}, max(pos) AS pos,
        list({{'tag': tag, 'score': score}} ORDER BY r) FILTER (WHERE r <= {NTOP}) AS top_tags,
        list(tag ORDER BY r) FILTER (WHERE score >= {thr}) AS passing, arg_min(tag, r) AS top1
      FROM rk GROUP BY {K4}),
    {name} AS (SELECT {K4}, {pos} AS pos, top_tags,
        CASE WHEN passing IS NULL OR len(passing) = 0 THEN [top1] ELSE passing[1:{MAXT}] END AS predicted_tags
      FROM {name}_p0)"""


BASE = f"""
    sc AS ({dv.SCORES_LONG_SQL}),
    rk AS (SELECT *, row_number() OVER (PARTITION BY {K4} ORDER BY score DESC, tag) AS r FROM sc),
    {_preds_sql('run0', 0.0, 'pos * 2')},
    {_preds_sql('run1', THR, 'pos * 2 + 1')},
    pfile AS (SELECT * FROM run0 UNION ALL SELECT * FROM run1),
    latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {K4} ORDER BY pos DESC) AS rn FROM pfile) WHERE rn = 1),
    lab AS (SELECT * FROM ({dv.LABELS_FULL_SQL}) WHERE review_status = 'reviewed'),
    m AS (SELECT l.*, p.predicted_tags AS p_predicted_tags, p.top_tags AS p_top_tags,
                 list_distinct(coalesce(l.true_tags, [])) AS T, list_distinct(coalesce(p.predicted_tags, [])) AS P
          FROM lab l JOIN latest p ON """ + " AND ".join(f"l.{k} IS NOT DISTINCT FROM p.{k}" for k in KEY4) + """),
    univ AS (SELECT DISTINCT tag FROM (
        SELECT unnest(predicted_tags) AS tag FROM latest
        UNION ALL SELECT unnest(true_tags) FROM m
        UNION ALL SELECT primary_tag FROM m WHERE primary_tag IS NOT NULL AND primary_tag <> '')),
    ex AS (SELECT T, P, unnest(list_distinct(T || P)) AS tag FROM m),
    cnt AS (SELECT tag,
        CAST(sum(CASE WHEN list_contains(T, tag) AND list_contains(P, tag) THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN NOT list_contains(T, tag) AND list_contains(P, tag) THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN list_contains(T, tag) AND NOT list_contains(P, tag) THEN 1 ELSE 0 END) AS BIGINT) AS fn
      FROM ex GROUP BY tag),
    nrows AS (SELECT count(*) AS n FROM m),
    pt0 AS (SELECT u.tag, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM univ u LEFT JOIN cnt c ON u.tag = c.tag),
    pt1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
                      CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall FROM pt0),
    per_tag AS (SELECT pt1.*, (SELECT n FROM nrows) - tp - fp - fn AS tn, tp + fn AS support, tp + fp AS predicted,
                 CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pt1)"""


def _join_list(expr: str) -> str:
    return f"array_to_string({expr}, ', ')"


@register(
    "c6_c9_predictions",
    f"WITH {BASE} SELECT {K4}, array_to_string(predicted_tags, ',') AS predicted_tags, "
    "array_to_string(list_transform(top_tags, lambda s: s.tag || ':' || CAST(s.score AS VARCHAR)), ',') AS top_tags "
    "FROM run1",
)
def q_c6_c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.select(
        *KEY4,
        F.array_join("predicted_tags", ",").alias("predicted_tags"),
        F.array_join(
            F.transform("top_tags", lambda s: F.concat(s["tag"], F.lit(":"), s["score"].cast("string"))), ","
        ).alias("top_tags"),
    )


@register(
    "s13_latest_predictions",
    f"WITH {BASE} SELECT {K4}, pos, array_to_string(predicted_tags, ',') AS predicted_tags FROM latest",
)
def q_s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.latest_predictions(prediction_file(spark, sf_dir))
    return p.select(*KEY4, "pos", F.array_join("predicted_tags", ",").alias("predicted_tags"))


@register(
    "e1_matched_labels",
    f"WITH {BASE} SELECT id, source_row, array_to_string(true_tags, ',') AS true_tags, "
    "array_to_string(p_predicted_tags, ',') AS predicted_tags FROM m",
)
def q_e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = matched(spark, sf_dir)
    return m.select(
        "id",
        "source_row",
        F.array_join("true_tags", ",").alias("true_tags"),
        F.array_join("p_predicted_tags", ",").alias("predicted_tags"),
    )


@register("e2_tag_universe", f"WITH {BASE} SELECT tag FROM univ")
def q_e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, preds = matched(spark, sf_dir)
    return ev.universe_eval(m, preds)


PER_TAG_COLS = ["tag", "tp", "fp", "fn", "tn", "support", "predicted", "precision", "recall", "f1"]


@register(
    "e4_per_tag_metrics",
    f"WITH {BASE} SELECT tag, tp, fp, fn, tn, support, predicted, {s6('precision')} AS precision, "
    f"{s6('recall')} AS recall, {s6('f1')} AS f1 FROM per_tag",
)
def q_e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = _per_tag(spark, sf_dir)
    return pt.select(
        "tag", *[F.col(c).cast("long").alias(c) for c in ["tp", "fp", "fn", "tn", "support", "predicted"]],
        *[r6(c).alias(c) for c in ["precision", "recall", "f1"]],
    )


OVERALL_COLS = [
    "exact_match_accuracy", "mean_jaccard", "hamming_loss", "micro_precision", "micro_recall", "micro_f1",
    "macro_precision", "macro_recall", "macro_f1",
]

OVERALL_SQL = f"""WITH {BASE},
    rs AS (SELECT len(list_filter(T, lambda x: list_contains(P, x))) AS inter, len(T) AS nt, len(P) AS np FROM m),
    rs2 AS (SELECT *, nt + np - inter AS uni, nt - inter AS miss, np - inter AS extra FROM rs),
    agg AS (SELECT count(*) AS n, avg(CASE WHEN miss = 0 AND extra = 0 THEN 1.0 ELSE 0.0 END) AS exact,
                   avg(CASE WHEN uni > 0 THEN CAST(inter AS DOUBLE) / uni ELSE 0.0 END) AS jacc,
                   sum(miss + extra) AS ham, sum(inter) AS tp, sum(extra) AS fp, sum(miss) AS fn FROM rs2),
    u AS (SELECT count(*) AS u, sum(precision) AS sp, sum(recall) AS sr, sum(f1) AS sf FROM per_tag),
    mic AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS mp,
                      CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS mr FROM agg, u)
    SELECT n AS reviewed_examples, u AS tag_count, {s6('exact')} AS exact_match_accuracy, {s6('jacc')} AS mean_jaccard,
           {s6('CASE WHEN n * u > 0 THEN CAST(ham AS DOUBLE) / (n * u) ELSE 0.0 END')} AS hamming_loss,
           {s6('mp')} AS micro_precision, {s6('mr')} AS micro_recall,
           {s6('CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0.0 END')} AS micro_f1,
           {s6('sp / u')} AS macro_precision, {s6('sr / u')} AS macro_recall, {s6('sf / u')} AS macro_f1 FROM mic"""


@register("e5_e9_overall_metrics", OVERALL_SQL)
def q_e5_e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, preds = matched(spark, sf_dir)
    u = ev.universe_eval(m, preds).count()
    o = ev.overall(m, u)
    return o.select(
        F.col("reviewed_examples").cast("long"), F.col("tag_count").cast("long"), *[r6(c).alias(c) for c in OVERALL_COLS]
    )


CONF_SQL = f"""WITH {BASE},
    cells0 AS (SELECT CASE WHEN primary_tag IS NOT NULL AND primary_tag <> '' THEN primary_tag ELSE true_tags[1] END AS true_tag,
                      p_predicted_tags[1] AS predicted_tag FROM m),
    cells AS (SELECT true_tag, predicted_tag, count(*) AS n FROM cells0
              WHERE true_tag IN (SELECT tag FROM univ) AND predicted_tag IN (SELECT tag FROM univ) GROUP BY 1, 2)"""


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, preds = matched(spark, sf_dir)
    return ev.primary_confusion(m, ev.universe_eval(m, preds))


@register("e10_primary_confusion", CONF_SQL + " SELECT true_tag, predicted_tag, n FROM cells")
def q_e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


@register(
    "e10_primary_accuracy",
    CONF_SQL
    + f" SELECT {s6('CASE WHEN sum(n) > 0 THEN CAST(sum(CASE WHEN true_tag = predicted_tag THEN n ELSE 0 END) AS DOUBLE) / sum(n) ELSE 0.0 END')} AS accuracy, "
    "CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM cells",
)
def q_e10_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ev.primary_accuracy(_confusion(spark, sf_dir))
    return a.select(r6("accuracy").alias("accuracy"), F.col("total").cast("long"))


@register(
    "e11_confusion_pairs",
    f"""WITH {BASE},
    pr AS (SELECT pos, list_sort(list_filter(T, lambda x: NOT list_contains(P, x))) AS miss,
                  list_sort(list_filter(P, lambda x: NOT list_contains(T, x))) AS extra FROM m),
    mi AS (SELECT pos, extra, unnest(miss) AS mm, unnest(generate_series(1, len(miss))) AS i FROM pr),
    pairs AS (SELECT pos, i, mm, unnest(extra) AS ee, unnest(generate_series(1, len(extra))) AS j FROM mi),
    agg AS (SELECT mm, ee, count(*) AS count, min({{'a': pos, 'b': i, 'c': j}}) AS first FROM pairs GROUP BY mm, ee),
    top AS (SELECT mm || ' -> ' || ee AS pair, count, row_number() OVER (ORDER BY count DESC, first) AS rank FROM agg)
    SELECT pair, count, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 50""",
)
def q_e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = matched(spark, sf_dir)
    pairs = ev.confusion_pairs(m, 50)
    # the window runs over the 50 selected pairs only
    w = Window.orderBy(F.desc("count"), F.asc("__first"))
    return pairs.select("pair", "count", F.row_number().over(w).cast("int").alias("rank"))


@register(
    "e12_disagreements",
    f"""WITH {BASE}
    SELECT id, source_row, response_index, {_join_list('true_tags')} AS true_tags,
           {_join_list('p_predicted_tags')} AS predicted_tags,
           {_join_list('list_sort(list_filter(T, lambda x: NOT list_contains(P, x)))')} AS missing_tags,
           {_join_list('list_sort(list_filter(P, lambda x: NOT list_contains(T, x)))')} AS extra_tags,
           replace(substr(coalesce(assistant_output, ''), 1, 300), chr(10), ' ') AS assistant_preview
    FROM m WHERE len(list_filter(T, lambda x: NOT list_contains(P, x))) > 0
              OR len(list_filter(P, lambda x: NOT list_contains(T, x))) > 0""",
)
def q_e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = matched(spark, sf_dir)
    return ev.disagreements(m)


@register(
    "e13_normalized_confusion",
    CONF_SQL
    + f" SELECT true_tag, predicted_tag, n, {s6('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY true_tag)')} AS share FROM cells",
)
def q_e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.normalized_confusion(_confusion(spark, sf_dir))
    return c.select("true_tag", "predicted_tag", "n", r6("share").alias("share"))


@register("e14_active_confusion", CONF_SQL + " SELECT true_tag, predicted_tag, n FROM cells WHERE n > 0")
def q_e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.active_confusion(_confusion(spark, sf_dir))


@register(
    "e15_tags_by_support",
    f"WITH {BASE} SELECT tag, support, {s6('f1')} AS f1, "
    "CAST(row_number() OVER (ORDER BY support DESC, tag) AS INTEGER) AS position FROM per_tag",
)
def q_e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = _per_tag(spark, sf_dir)
    # window over the per-tag rows (bounded by the vocabulary)
    w = Window.orderBy(F.desc("support"), F.asc("tag"))
    return pt.select("tag", F.col("support").cast("long"), r6("f1").alias("f1"), F.row_number().over(w).cast("int").alias("position"))


@register(
    "e16_tags_to_inspect",
    f"WITH {BASE} SELECT tag, CAST(row_number() OVER (ORDER BY support DESC, round(f1, 9) DESC, tag) AS INTEGER) AS position "
    "FROM per_tag QUALIFY position <= 3",
)
def q_e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = ev.tags_to_inspect(_per_tag(spark, sf_dir).withColumn("f1", F.round("f1", 9)), None, 3)
    return spark.createDataFrame([(t, i + 1) for i, t in enumerate(tags)], "tag string, position int")


@register(
    "e17_primary_for_labels",
    f"""WITH {BASE},
    alll AS ({dv.LABELS_FULL_SQL}),
    cls AS (SELECT unnest({dv._sql_list(dv.TAGS)}) AS tag, unnest(generate_series(1, {dv.N_TAGS})) AS o),
    ex17 AS (SELECT id, unnest(true_tags) AS tag FROM alll),
    j AS (SELECT ex17.id, ex17.tag, coalesce(pt.support, 0) AS s, cls.o FROM ex17 JOIN cls ON ex17.tag = cls.tag
          LEFT JOIN per_tag pt ON ex17.tag = pt.tag),
    best AS (SELECT id, arg_min(tag, {{'a': -s, 'b': o}}) AS tag FROM j GROUP BY id)
    SELECT a.id, coalesce(b.tag, 'unlabeled') AS primary_label FROM alll a LEFT JOIN best b ON a.id = b.id""",
)
def q_e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = {r["tag"]: int(r["support"]) for r in _per_tag(spark, sf_dir).select("tag", "support").collect()}
    labels = dv.label_entries(spark, sf_dir)
    return labels.select("id", ev.primary_for_labels(F.col("true_tags"), dv.TAGS, support).alias("primary_label"))


# ----------------------------------------------------------------------------
# Sweep
# ----------------------------------------------------------------------------

def _settings_values() -> str:
    vals = []
    pos = 0
    for t in sw.DEFAULT_THRESHOLDS:
        for c in sw.DEFAULT_MAX_TAGS:
            vals.append(f"({pos}, CAST({t!r} AS DOUBLE), {c})")
            pos += 1
    return "(VALUES " + ", ".join(vals) + ") s(setting_pos, threshold, max_tags)"


def sweep_sql(allow_empty: bool = False) -> str:
    fallback = "n0" if allow_empty else "(CASE WHEN n0 = 0 AND len(ranked) > 0 THEN 1 ELSE n0 END)"
    return f"""WITH {BASE},
    r0 AS (SELECT T, CASE WHEN primary_tag IS NOT NULL AND primary_tag <> '' THEN primary_tag ELSE true_tags[1] END AS tprim,
                  CASE WHEN len(coalesce(p_top_tags, [])) > 0 THEN p_top_tags
                       ELSE list_transform(p_predicted_tags, lambda tg: {{'tag': tg, 'score': CAST(0.0 AS DOUBLE)}}) END AS base FROM m),
    r1 AS (SELECT T, tprim, list_transform(list_sort(list_transform(base, lambda x, i: {{'k': -CAST(x.score AS DOUBLE), 'i': i, 'tag': x.tag, 'score': CAST(x.score AS DOUBLE)}})),
                  lambda s: {{'tag': s.tag, 'score': s.score}}) AS ranked FROM r0),
    r2 AS (SELECT r1.*, s.* FROM r1 CROSS JOIN {_settings_values()}),
    r3 AS (SELECT *, least(len(list_filter(ranked, lambda q: q.score >= threshold)), max_tags) AS n0 FROM r2),
    r4 AS (SELECT *, list_transform(ranked[1:{fallback}], lambda q: q.tag) AS plist FROM r3),
    r5 AS (SELECT *, list_distinct(plist) AS P FROM r4),
    rs AS (SELECT *, len(list_filter(T, lambda x: list_contains(P, x))) AS inter, len(T) AS nt, len(P) AS np FROM r5),
    rs2 AS (SELECT *, nt + np - inter AS uni, nt - inter AS miss, np - inter AS extra FROM rs),
    agg AS (SELECT setting_pos, threshold, max_tags, count(*) AS n, avg(np) AS mean_pred,
                   avg(CASE WHEN miss = 0 AND extra = 0 THEN 1.0 ELSE 0.0 END) AS exact,
                   avg(CASE WHEN uni > 0 THEN CAST(inter AS DOUBLE) / uni ELSE 0.0 END) AS jacc,
                   sum(miss + extra) AS ham, sum(inter) AS tp, sum(extra) AS fp, sum(miss) AS fn,
                   sum(CASE WHEN tprim IS NOT NULL THEN 1 ELSE 0 END) AS ptot,
                   sum(CASE WHEN tprim IS NOT NULL AND tprim = plist[1] THEN 1 ELSE 0 END) AS pcor
            FROM rs2 GROUP BY 1, 2, 3),
    ex2 AS (SELECT setting_pos, T, P, unnest(list_distinct(T || P)) AS tag FROM r5),
    c2 AS (SELECT setting_pos, tag,
              sum(CASE WHEN list_contains(T, tag) AND list_contains(P, tag) THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN NOT list_contains(T, tag) AND list_contains(P, tag) THEN 1 ELSE 0 END) AS fp,
              sum(CASE WHEN list_contains(T, tag) AND NOT list_contains(P, tag) THEN 1 ELSE 0 END) AS fn
           FROM ex2 GROUP BY 1, 2),
    c3 AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS pr,
                     CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS rc FROM c2),
    mac AS (SELECT setting_pos, sum(pr) AS sp, sum(rc) AS sr,
                   sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) AS sf FROM c3 GROUP BY 1),
    uw AS (SELECT count(*) AS u FROM (SELECT DISTINCT tag FROM (
            SELECT unnest(true_tags) AS tag FROM m
            UNION ALL SELECT unnest(top_tags).tag FROM latest
            UNION ALL SELECT unnest(predicted_tags) FROM latest))),
    res0 AS (SELECT a.*, coalesce(sp, 0.0) AS sp, coalesce(sr, 0.0) AS sr, coalesce(sf, 0.0) AS sf, u,
                CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS mp,
                CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS mr
             FROM agg a LEFT JOIN mac ON a.setting_pos = mac.setting_pos, uw),
    res AS (SELECT setting_pos, threshold, max_tags, n AS reviewed_examples, mean_pred AS mean_predicted_tags,
                   exact AS exact_match_accuracy, jacc AS mean_jaccard,
                   CASE WHEN n * u > 0 THEN CAST(ham AS DOUBLE) / (n * u) ELSE 0.0 END AS hamming_loss,
                   CASE WHEN ptot > 0 THEN CAST(pcor AS DOUBLE) / ptot ELSE 0.0 END AS primary_accuracy,
                   mp AS micro_precision, mr AS micro_recall,
                   CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0.0 END AS micro_f1,
                   sp / u AS macro_precision, sr / u AS macro_recall, sf / u AS macro_f1 FROM res0),
    ranked AS (SELECT *, row_number() OVER (ORDER BY round(micro_f1, 9) DESC, round(mean_jaccard, 9) DESC,
                      round(micro_f1, 9) DESC, round(mean_predicted_tags, 9) ASC, setting_pos) AS rank FROM res)"""


SWEEP_SQL = sweep_sql(False)

SWEEP_METRICS = [c for c in sw.CSV_COLUMNS if c not in ("threshold", "max_tags", "reviewed_examples")]


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, preds = matched(spark, sf_dir)
    u = sw.universe_sweep(m, preds).count()
    return sw.rank_settings(sw.sweep(m, u), "micro_f1")


@register(
    "w4_w5_threshold_sweep",
    SWEEP_SQL
    + " SELECT setting_pos, threshold, max_tags, CAST(reviewed_examples AS BIGINT) AS reviewed_examples, "
    + ", ".join(f"{s6(c)} AS {c}" for c in SWEEP_METRICS)
    + ", CAST(rank AS INTEGER) AS rank FROM ranked",
)
def q_w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _sweep(spark, sf_dir)
    return r.select(
        "setting_pos", "threshold", "max_tags", F.col("reviewed_examples").cast("long"),
        *[r6(c).alias(c) for c in SWEEP_METRICS], F.col("rank").cast("int"),
    )


@register(
    "w7_best_per_threshold",
    SWEEP_SQL
    + f" SELECT threshold, max_tags, {s6('micro_f1')} AS micro_f1, {s6('macro_f1')} AS macro_f1, "
    f"{s6('mean_jaccard')} AS mean_jaccard FROM ranked "
    "QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY round(micro_f1, 9) DESC, max_tags) = 1",
)
def q_w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sw.best_per_threshold(_sweep(spark, sf_dir))
    return b.select("threshold", "max_tags", *[r6(c).alias(c) for c in ["micro_f1", "macro_f1", "mean_jaccard"]])


@register(
    "w8_f1_curves",
    SWEEP_SQL + f" SELECT max_tags, threshold, {s6('micro_f1')} AS micro_f1 FROM ranked",
)
def q_w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sw.f1_curves(_sweep(spark, sf_dir))
    return c.select("max_tags", "threshold", r6("micro_f1").alias("micro_f1"))


@register(
    "w3_allow_empty_sweep",
    sweep_sql(True)
    + f" SELECT threshold, max_tags, {s6('mean_predicted_tags')} AS mean_predicted_tags, {s6('micro_f1')} AS micro_f1 FROM ranked",
)
def q_w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep with the top-1 fallback turned off (``allow_empty``)."""
    m, preds = matched(spark, sf_dir)
    u = sw.universe_sweep(m, preds).count()
    r = sw.sweep(m, u, allow_empty=True)
    return r.select("threshold", "max_tags", r6("mean_predicted_tags").alias("mean_predicted_tags"), r6("micro_f1").alias("micro_f1"))


@register(
    "w4_per_tag_by_setting",
    SWEEP_SQL
    + f""",
    names AS (SELECT DISTINCT tag FROM (
            SELECT unnest(true_tags) AS tag FROM m
            UNION ALL SELECT unnest(top_tags).tag FROM latest
            UNION ALL SELECT unnest(predicted_tags) FROM latest)),
    full_grid AS (SELECT a.setting_pos, a.threshold, a.max_tags, a.n, names.tag, coalesce(c3.tp, 0) AS tp, coalesce(c3.fp, 0) AS fp,
                    coalesce(c3.fn, 0) AS fn, coalesce(pr, 0.0) AS pr, coalesce(rc, 0.0) AS rc
             FROM agg a CROSS JOIN names LEFT JOIN c3 ON c3.setting_pos = a.setting_pos AND c3.tag = names.tag)
    SELECT setting_pos, threshold, max_tags, tag, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
           CAST(n - tp - fp - fn AS BIGINT) AS tn, CAST(tp + fn AS BIGINT) AS support, CAST(tp + fp AS BIGINT) AS predicted,
           {s6('pr')} AS precision, {s6('rc')} AS recall,
           {s6('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END')} AS f1 FROM full_grid""",
)
def q_w4_per_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and metrics of every tag at every setting of the sweep."""
    m, preds = matched(spark, sf_dir)
    out = sw.per_tag_by_setting(m, sw.universe_sweep(m, preds))
    return out.select(
        "setting_pos", "threshold", "max_tags", "tag", "tp", "fp", "fn", "tn", "support", "predicted",
        *[r6(c).alias(c) for c in ("precision", "recall", "f1")],
    )
