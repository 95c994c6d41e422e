"""Decision-threshold sweep (W1-W8) as one difference sweep.

A ranking is sorted by score, so the ``i``-th tag of a row is predicted at
exactly the settings with a threshold up to its score and a cap of at least
``i``.  Every tag therefore contributes its counts, and the change it makes to
its row's metrics, once, at ``(number of thresholds up to the score, i)``; one
aggregation sums these steps, and the settings are sums over the few cells.
The work on rows doesn't grow with the number of settings, and the counts of
each tag at each setting come from the same cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import f1, safe_divide
from .evaluate import tag_metrics, true_primary

# The default grid of the reference sweep.
DEFAULT_THRESHOLDS = [-1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0]
DEFAULT_MAX_TAGS = [1, 2, 3, 4, 5]
SELECTION_METRICS = ["micro_f1", "macro_f1", "mean_jaccard", "exact_match_accuracy", "primary_accuracy"]
CSV_COLUMNS = [
    "threshold",
    "max_tags",
    "reviewed_examples",
    "mean_predicted_tags",
    "exact_match_accuracy",
    "mean_jaccard",
    "hamming_loss",
    "primary_accuracy",
    "micro_precision",
    "micro_recall",
    "micro_f1",
    "macro_precision",
    "macro_recall",
    "macro_f1",
]


def check_metric(metric: str) -> str:
    """The selection metric must be one of five."""
    if metric not in SELECTION_METRICS:
        raise ValueError(f"selection metric must be one of {SELECTION_METRICS}, got {metric!r}")
    return metric


def settings(thresholds: Sequence[float] = DEFAULT_THRESHOLDS, caps: Sequence[int] = DEFAULT_MAX_TAGS) -> Column:
    """The grid as a literal ``array<struct<setting_pos, threshold,
    max_tags>>`` in threshold-then-cap list order."""
    items = []
    pos = 0
    for t in thresholds:
        for c in caps:
            items.append(
                F.struct(F.lit(pos).alias("setting_pos"), F.lit(float(t)).alias("threshold"), F.lit(int(c)).alias("max_tags"))
            )
            pos += 1
    return F.array(*items)


def reranked(top_tags: Column, predicted_tags: Column) -> Column:
    """Saved top tags re-sorted by score (stable), or the predicted tags
    with score 0.0 when no top tags were saved."""
    typ = "array<struct<tag:string,score:double>>"
    base = F.when(
        F.size(F.coalesce(top_tags.cast(typ), F.array().cast(typ))) > 0, top_tags.cast(typ)
    ).otherwise(
        F.transform(
            F.coalesce(predicted_tags, F.array().cast("array<string>")),
            lambda t: F.struct(t.alias("tag"), F.lit(0.0).alias("score")),
        ).cast(typ)
    )
    keyed = F.transform(
        base,
        lambda x, i: F.named_struct(
            F.lit("k"), -F.coalesce(x["score"], F.lit(0.0)),
            F.lit("i"), i,
            F.lit("tag"), x["tag"],
            F.lit("score"), F.coalesce(x["score"], F.lit(0.0)),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["tag"].alias("tag"), s["score"].alias("score")))


def at_setting(ranked: Column, threshold: Column, cap: Column, allow_empty: bool = False) -> Column:
    """The ranking is sorted by score, so the passing tags form a prefix:
    length ``least(#passing, cap)``, or 1 when that is 0 (top-1 fallback)."""
    k = F.size(F.filter(ranked, lambda s: s["score"] >= threshold))
    n = F.least(k, cap)
    if not allow_empty:
        n = F.when((n == 0) & (F.size(ranked) > 0), F.lit(1)).otherwise(n)
    return F.transform(F.slice(ranked, 1, n), lambda s: s["tag"])


def _level(score: Column, thresholds: Sequence[float], first: int = 0, last: int | None = None) -> Column:
    """How many of the ascending thresholds are at most the score, by halving."""
    last = len(thresholds) if last is None else last
    if first == last:
        return F.lit(first)
    mid = (first + last) // 2
    above = F.isnan(score) | (score >= F.lit(float(thresholds[mid])))
    return F.when(above, _level(score, thresholds, mid + 1, last)).otherwise(_level(score, thresholds, first, mid))


#: what a cell adds up: counts of a tag, then changes of row metrics
_SUMS = ["tp", "fp", "support", "rows", "exact", "jaccard", "hamming", "primary_total", "primary_right"]


def sweep_cells(matched: DataFrame, thresholds: Sequence[float], caps: Sequence[int], allow_empty: bool) -> DataFrame:
    """``level, pos, tag`` and the sums of the steps there: one aggregation
    over rows times their tags.  A step at ``(level, pos)`` holds at the
    settings with at most ``level`` thresholds up to their own and a cap of at
    least ``pos``; what holds at every setting lies at the highest level and
    position 0."""
    ladder = sorted(set(map(float, thresholds)))
    top = len(ladder)
    rows = matched.select(
        F.array_distinct(F.coalesce(F.col("true_tags"), F.array().cast("array<string>"))).alias("true"),
        true_primary().alias("primary"),
        F.slice(reranked(F.col("p_top_tags"), F.col("p_predicted_tags")), 1, max([1, *caps])).alias("ranked"),
    ).withColumn("tags", F.transform("ranked", lambda x: x["tag"]))
    n_true = F.size("true")

    def after(i: Column) -> dict[str, Column]:
        """A row's metrics with its first ``i`` tags predicted."""
        own = F.array_distinct(F.slice("tags", 1, i))
        hits, n = F.size(F.array_intersect(own, "true")), F.size(own)
        return {
            "exact": ((hits == n_true) & (n == n_true)).cast("double"),
            "jaccard": safe_divide(hits, n_true + n - hits),
            "hamming": (n_true + n - 2 * hits).cast("double"),
            "primary_right": F.coalesce((i >= 1) & (F.col("primary") == F.try_element_at("tags", F.lit(1))), F.lit(False)).cast("double"),
        }

    zero = {c: F.lit(0.0) for c in _SUMS}

    def entry(level: Column, pos: Column, tag: Column, **values: Column) -> Column:
        own = zero | {k: v.cast("double") for k, v in values.items()}
        return F.struct(level.alias("level"), pos.alias("pos"), tag.alias("tag"), *[own[c].alias(c) for c in _SUMS])

    def step(x: Column, i0: Column) -> Column:
        i = i0 + 1
        new = F.array_position("tags", x["tag"]) == i
        hit = F.array_contains("true", x["tag"])
        now, before = after(i), after(i - 1)
        always = F.lit(not allow_empty) & (i == 1)
        return entry(
            F.when(always, F.lit(top)).otherwise(_level(x["score"], ladder)), F.when(always, F.lit(0)).otherwise(i), x["tag"],
            tp=new & hit, fp=new & ~hit, **{k: now[k] - before[k] for k in now},
        )

    none = F.lit(None).cast("string")
    always = F.array(entry(F.lit(top), F.lit(0), none, rows=F.lit(1), primary_total=F.col("primary").isNotNull(), **after(F.lit(0))))
    held = F.transform("true", lambda t: entry(F.lit(top), F.lit(0), t, support=F.lit(1)))
    steps = F.transform("ranked", step)
    exploded = rows.select(F.explode(F.concat(always, held, steps)).alias("s")).select("s.*")
    return exploded.groupBy("level", "pos", "tag").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _at_settings(cells: DataFrame, thresholds: Sequence[float], caps: Sequence[int]) -> DataFrame:
    """Sums of the cells for each setting and tag (null: rows without tags);
    bounded by settings times tags, whatever the rows."""
    ladder = sorted(set(map(float, thresholds)))
    need = F.array(*[F.lit(ladder.index(float(t)) + 1) for t in thresholds for _ in caps])
    held = F.filter(settings(thresholds, caps), lambda s: (F.get(need, s["setting_pos"]) <= F.col("level")) & (s["max_tags"] >= F.col("pos")))
    return cells.withColumn("s", F.explode(held)).groupBy("s.setting_pos", "s.threshold", "s.max_tags", "tag").agg(
        *[F.sum(c).alias(c) for c in _SUMS]
    )


def sweep(
    matched: DataFrame,
    universe_size: int,
    thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
    caps: Sequence[int] = DEFAULT_MAX_TAGS,
    allow_empty: bool = False,
) -> DataFrame:
    """All metrics for every setting, one row per setting.

    Primary accuracy here counts every row with a true primary tag, even when
    nothing is predicted (unlike the evaluation's confusion matrix).
    """
    own = _at_settings(sweep_cells(matched, thresholds, caps, allow_empty), thresholds, caps)
    own = tag_metrics(own.withColumn("fn", F.col("support") - F.col("tp")))
    g = ["setting_pos", "threshold", "max_tags"]
    macro = ["precision", "recall", "f1"]
    t = own.groupBy(*g).agg(*[F.sum(c).alias(f"__{c}") for c in [*_SUMS, "fn", *macro]])
    n, u = F.col("__rows"), F.lit(float(universe_size))
    micro_p = safe_divide("__tp", F.col("__tp") + F.col("__fp"))
    micro_r = safe_divide("__tp", F.col("__tp") + F.col("__fn"))
    return t.select(
        *g,
        n.cast("long").alias("reviewed_examples"),
        safe_divide(F.col("__tp") + F.col("__fp"), n).alias("mean_predicted_tags"),
        safe_divide("__exact", n).alias("exact_match_accuracy"),
        safe_divide("__jaccard", n).alias("mean_jaccard"),
        safe_divide("__hamming", n * u).alias("hamming_loss"),
        safe_divide("__primary_right", "__primary_total").alias("primary_accuracy"),
        micro_p.alias("micro_precision"),
        micro_r.alias("micro_recall"),
        f1(micro_p, micro_r).alias("micro_f1"),
        *[safe_divide(f"__{c}", u).alias(f"macro_{c}") for c in macro],
    )


def per_tag_by_setting(
    matched: DataFrame,
    universe: DataFrame,
    thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
    caps: Sequence[int] = DEFAULT_MAX_TAGS,
    allow_empty: bool = False,
) -> DataFrame:
    """W4, per-tag part: counts and metrics of every tag of the universe at
    every setting (tags without activity get zeros)."""
    g = ["setting_pos", "threshold", "max_tags"]
    own = _at_settings(sweep_cells(matched, thresholds, caps, allow_empty), thresholds, caps)
    rows = own.groupBy(*g).agg(F.sum("rows").alias("__n"))
    # settings times tags: both bounded by the grid and the tag vocabulary
    grid = universe.select("tag").withColumn("s", F.explode(settings(thresholds, caps))).select("tag", "s.*")
    counts = ["tp", "fp", "support"]
    out = grid.join(own.where("tag is not null").select(*g, "tag", *counts), [*g, "tag"], "left").join(rows, g)
    out = out.select(*g, "tag", "__n", *[F.coalesce(c, F.lit(0.0)).cast("long").alias(c) for c in counts])
    out = tag_metrics(out.withColumn("fn", F.col("support") - F.col("tp")))
    tn = F.col("__n").cast("long") - F.col("tp") - F.col("fp") - F.col("fn")
    return out.withColumn("tn", tn).select(*g, "tag", "tp", "fp", "fn", "tn", "support", "predicted", "precision", "recall", "f1")


def with_per_tag(results: DataFrame, per_tag: DataFrame) -> DataFrame:
    """The sweep's rows with an array ``per_tag`` of their tags' metrics, in
    tag order (K11's JSON)."""
    fields = ["tag", "tp", "fp", "fn", "tn", "support", "predicted", "precision", "recall", "f1"]
    nested = per_tag.groupBy("setting_pos").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("per_tag"))
    return results.join(nested, "setting_pos", "left")


def rank_settings(results: DataFrame, metric: str = "micro_f1", digits: int = 9) -> DataFrame:
    """Rank by (metric, mean_jaccard, micro_f1) descending and mean
    predicted tags ascending; equal settings keep grid order.  Values are
    rounded to ``digits`` before comparing so last-bit noise cannot reorder.
    The window runs over the (small) per-setting rows."""
    check_metric(metric)
    r = lambda c: F.round(F.col(c), digits)
    w = Window.orderBy(r(metric).desc(), r("mean_jaccard").desc(), r("micro_f1").desc(), r("mean_predicted_tags").asc(), F.asc("setting_pos"))
    return results.withColumn("rank", F.row_number().over(w))


def best_per_threshold(results: DataFrame, digits: int = 9) -> DataFrame:
    """For each threshold the setting with the best micro F1 (ties to the
    smaller cap)."""
    w = Window.partitionBy("threshold").orderBy(F.round("micro_f1", digits).desc(), F.asc("max_tags"))
    return results.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def f1_curves(results: DataFrame) -> DataFrame:
    """Micro F1 by threshold for each cap."""
    return results.select("max_tags", "threshold", "micro_f1").orderBy("max_tags", "threshold")


def universe_sweep(matched: DataFrame, all_preds: DataFrame) -> DataFrame:
    """True tags of the reviewed rows, ranked tags and predicted tags of
    all predictions (no primary tags, no support keys)."""
    a = matched.select(F.explode("true_tags").alias("tag"))
    b = all_preds.select(F.explode(reranked(F.col("top_tags"), F.col("predicted_tags"))).alias("x")).select(
        F.col("x.tag").alias("tag")
    )
    c = all_preds.select(F.explode("predicted_tags").alias("tag"))
    return a.unionByName(b).unionByName(c).distinct()
