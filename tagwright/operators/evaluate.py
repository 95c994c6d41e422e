"""Evaluation of predicted tag sets against reviewed labels.

Shape of the inputs:

* predictions: the four key columns, ``predicted_tags array<string>``,
  ``top_tags array<struct<tag, score>>`` and ``pos`` (file position);
* labels: ``id``, the four keys, ``true_tags``, ``primary_tag``,
  ``review_status``, ``assistant_output`` and ``pos``.

Set metrics are array expressions per row followed by aggregations; per-tag
counts explode only the tags a row actually has (true or predicted), never
rows x all tags, and ``tn`` comes from the row count.  Macro means divide by
the size of the tag universe, so tags without any activity need no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions.text import f1, safe_divide

KEY4 = ["source_split", "source_row", "response_index", "prompt_id"]


def latest_predictions(preds: DataFrame, keys: Sequence[str] = KEY4) -> DataFrame:
    """One prediction per key, the last in file order winning.  An
    aggregation (``max_by``), so a duplicated key is combined map-side."""
    others = [c for c in preds.columns if c not in keys]
    return preds.groupBy(*keys).agg(F.max_by(F.struct(*others), "pos").alias("__p")).select(*keys, "__p.*")


def reviewed_only(labels: DataFrame, include_unreviewed: bool = False) -> DataFrame:
    """Keep ``review_status = 'reviewed'`` unless told otherwise."""
    return labels if include_unreviewed else labels.where(F.col("review_status") == "reviewed")


def _key_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def match_labels(labels: DataFrame, preds: DataFrame, keys: Sequence[str] = KEY4, check: bool = True) -> DataFrame:
    """Join labels to (deduplicated) predictions on null-safe keys.

    Every label must find a prediction: with ``check`` the unmatched labels
    are counted first and the call fails naming up to five of them.
    """
    p = preds.select(*keys, *[F.col(c).alias(f"p_{c}") for c in preds.columns if c not in keys])
    if check:
        missing = labels.join(p, _key_match(labels, p, keys), "left_anti")
        bad = missing.select("id").limit(5).collect()
        if bad:
            n = missing.count()
            raise ValueError(f"{n} reviewed labels did not match predictions: {[r['id'] for r in bad]}")
    joined = labels.join(p, _key_match(labels, p, keys), "inner")
    return joined.select(
        *[labels[c] for c in labels.columns],
        *[p[c] for c in p.columns if c.startswith("p_")],
    )


def universe_eval(matched: DataFrame, all_preds: DataFrame, support_keys: Sequence[str] = ()) -> DataFrame:
    """Support-count keys, predicted tags of *all* predictions, true tags
    and non-empty primary tags of the reviewed labels."""
    parts = [
        all_preds.select(F.explode("predicted_tags").alias("tag")),
        matched.select(F.explode("true_tags").alias("tag")),
        matched.where(F.col("primary_tag").isNotNull() & (F.col("primary_tag") != "")).select(
            F.col("primary_tag").alias("tag")
        ),
    ]
    if support_keys:
        spark = matched.sparkSession
        parts.append(spark.createDataFrame([(k,) for k in support_keys], "tag string"))
    return reduce(DataFrame.unionByName, parts).distinct()


def with_sets(df: DataFrame, true_col: str = "true_tags", pred_col: str = "p_predicted_tags") -> DataFrame:
    t = F.array_distinct(F.coalesce(F.col(true_col), F.array().cast("array<string>")))
    p = F.array_distinct(F.coalesce(F.col(pred_col), F.array().cast("array<string>")))
    return df.withColumns({"__T": t, "__P": p})


def row_set_stats(df: DataFrame) -> DataFrame:
    """Per-row set sizes used by E5-E8 and W4 (expects ``__T`` and ``__P``)."""
    inter = F.size(F.array_intersect("__T", "__P"))
    union = F.size(F.array_union("__T", "__P"))
    miss = F.size(F.array_except("__T", "__P"))
    extra = F.size(F.array_except("__P", "__T"))
    return df.withColumns(
        {
            "__inter": inter.cast("long"),
            "__exact": (F.array_sort("__T") == F.array_sort("__P")).cast("long"),
            "__jacc": safe_divide(inter, union),
            "__ham": (miss + extra).cast("long"),
            "__miss": miss.cast("long"),
            "__extra": extra.cast("long"),
            "__npred": F.size("__P").cast("long"),
        }
    )


def per_tag_counts(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """tp/fp/fn per (group, tag) by exploding only the tags a row has."""
    g = list(group_cols)
    ex = df.select(*g, "__T", "__P", F.explode(F.array_union("__T", "__P")).alias("tag"))
    t = F.array_contains("__T", F.col("tag"))
    p = F.array_contains("__P", F.col("tag"))
    return ex.groupBy(*g, "tag").agg(
        F.sum((t & p).cast("long")).alias("tp"),
        F.sum((~t & p).cast("long")).alias("fp"),
        F.sum((t & ~p).cast("long")).alias("fn"),
    )


def tag_metrics(counts: DataFrame) -> DataFrame:
    p = safe_divide("tp", F.col("tp") + F.col("fp"))
    r = safe_divide("tp", F.col("tp") + F.col("fn"))
    return counts.withColumns(
        {
            "support": F.col("tp") + F.col("fn"),
            "predicted": F.col("tp") + F.col("fp"),
            "precision": p,
            "recall": r,
        }
    ).withColumn("f1", f1("precision", "recall"))


def per_tag(matched: DataFrame, universe: DataFrame) -> DataFrame:
    """Per-tag tp/fp/fn/tn, support, predicted, precision, recall, F1 for
    every tag of the universe (tags without activity get zeros)."""
    rows = with_sets(matched)
    n = rows.count()
    counts = tag_metrics(per_tag_counts(rows))
    out = universe.join(counts, "tag", "left").fillna(0, subset=["tp", "fp", "fn", "support", "predicted"]).fillna(
        0.0, subset=["precision", "recall", "f1"]
    )
    return out.withColumn("tn", F.lit(n) - F.col("tp") - F.col("fp") - F.col("fn")).select(
        "tag", "tp", "fp", "fn", "tn", "support", "predicted", "precision", "recall", "f1"
    )


def set_metrics(rows: DataFrame, group_cols: Sequence[str], universe_size: int) -> DataFrame:
    """E5-E9 (and W4) per group from rows carrying ``__T``/``__P``.

    One aggregation over rows for the row-level metrics and micro counts, one
    over exploded tags for the macro means; joined on the group key (both
    sides have one row per group).
    """
    g = list(group_cols)
    st = row_set_stats(rows)
    row_agg = st.groupBy(*g).agg(
        F.count(F.lit(1)).alias("reviewed_examples"),
        F.avg("__npred").alias("mean_predicted_tags"),
        F.avg("__exact").alias("exact_match_accuracy"),
        F.avg("__jacc").alias("mean_jaccard"),
        F.sum("__ham").alias("__ham"),
        F.sum("__inter").alias("__tp"),
        F.sum("__extra").alias("__fp"),
        F.sum("__miss").alias("__fn"),
    )
    tm = tag_metrics(per_tag_counts(st, g)).groupBy(*g).agg(
        F.sum("precision").alias("__sp"), F.sum("recall").alias("__sr"), F.sum("f1").alias("__sf")
    )
    u = F.lit(float(universe_size))
    micro_p = safe_divide("__tp", F.col("__tp") + F.col("__fp"))
    micro_r = safe_divide("__tp", F.col("__tp") + F.col("__fn"))
    if g:
        joined = row_agg.join(tm, g, "left")
    else:
        # two single-row aggregates: stack them and take each column's only value
        both = row_agg.unionByName(tm, allowMissingColumns=True)
        joined = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return joined.select(
        *g,
        "reviewed_examples",
        F.lit(universe_size).alias("tag_count"),
        "mean_predicted_tags",
        "exact_match_accuracy",
        "mean_jaccard",
        safe_divide("__ham", F.col("reviewed_examples") * u).alias("hamming_loss"),
        micro_p.alias("micro_precision"),
        micro_r.alias("micro_recall"),
        f1(micro_p, micro_r).alias("micro_f1"),
        safe_divide(F.coalesce("__sp", F.lit(0.0)), u).alias("macro_precision"),
        safe_divide(F.coalesce("__sr", F.lit(0.0)), u).alias("macro_recall"),
        safe_divide(F.coalesce("__sf", F.lit(0.0)), u).alias("macro_f1"),
    )


def overall(matched: DataFrame, universe_size: int) -> DataFrame:
    """E5-E9 for one evaluation (no grouping)."""
    return set_metrics(with_sets(matched), [], universe_size)


def true_primary(primary_col: str = "primary_tag", true_col: str = "true_tags") -> Column:
    """Reviewed primary tag, falling through an empty or missing value to the
    first true tag (original order)."""
    p = F.col(primary_col)
    return F.when(p.isNotNull() & (p != ""), p).otherwise(F.try_element_at(F.col(true_col), F.lit(1)))


def primary_confusion(matched: DataFrame, universe: DataFrame) -> DataFrame:
    """Sparse primary-tag confusion; rows whose true or predicted primary
    is outside the universe are left out of the total."""
    tp = true_primary()
    pp = F.try_element_at(F.col("p_predicted_tags"), F.lit(1))
    from .profile import join_small

    cells = matched.select(tp.alias("true_tag"), pp.alias("predicted_tag"))
    # the universe is the tag vocabulary: broadcast after a size check
    cells = join_small(cells, universe.select(F.col("tag").alias("true_tag")), "true_tag", 64, "left_semi")
    cells = join_small(cells, universe.select(F.col("tag").alias("predicted_tag")), "predicted_tag", 64, "left_semi")
    return cells.groupBy("true_tag", "predicted_tag").agg(F.count(F.lit(1)).alias("n"))


def primary_accuracy(confusion: DataFrame) -> DataFrame:
    """E10 summary: accuracy = diagonal / total over the sparse cells."""
    return confusion.agg(
        F.sum(F.when(F.col("true_tag") == F.col("predicted_tag"), F.col("n")).otherwise(0)).alias("correct"),
        F.sum("n").alias("total"),
    ).select(safe_divide("correct", "total").alias("accuracy"), F.coalesce("total", F.lit(0)).alias("total"))


def confusion_pairs(matched: DataFrame, limit: int = D.CONFUSION_PAIRS) -> DataFrame:
    """E11: "missing -> extra" pair counts, most common first, ties by first
    encounter (label position, then sorted missing, then sorted extra).  A row
    contributes at most |missing| x |extra| pairs, bounded by the vocabulary."""
    rows = with_sets(matched)
    miss = F.array_sort(F.array_except("__T", "__P"))
    extra = F.array_sort(F.array_except("__P", "__T"))
    pairs = F.flatten(
        F.transform(
            miss,
            lambda m, i: F.transform(
                extra, lambda e, j: F.struct(m.alias("m"), e.alias("e"), i.alias("i"), j.alias("j"))
            ),
        )
    )
    ex = rows.select("pos", F.explode(pairs).alias("x"))
    agg = ex.groupBy(F.col("x.m").alias("missing"), F.col("x.e").alias("extra")).agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("pos", "x.i", "x.j")).alias("__first")
    )
    ranked = agg.orderBy(F.desc("count"), F.asc("__first")).limit(limit)
    return ranked.select(F.concat_ws(" -> ", "missing", "extra").alias("pair"), "count", "__first")


def disagreements(matched: DataFrame) -> DataFrame:
    """Rows where a true tag is missing or an extra tag was predicted."""
    rows = with_sets(matched)
    miss = F.array_sort(F.array_except("__T", "__P"))
    extra = F.array_sort(F.array_except("__P", "__T"))
    return rows.where((F.size(miss) > 0) | (F.size(extra) > 0)).select(
        F.coalesce(F.col("id"), F.lit("")).alias("id"),
        F.col("source_row"),
        F.col("response_index"),
        F.array_join(F.coalesce("true_tags", F.array().cast("array<string>")), ", ").alias("true_tags"),
        F.array_join(F.coalesce("p_predicted_tags", F.array().cast("array<string>")), ", ").alias("predicted_tags"),
        F.array_join(miss, ", ").alias("missing_tags"),
        F.array_join(extra, ", ").alias("extra_tags"),
        F.replace(F.substring(F.coalesce("assistant_output", F.lit("")), 1, 300), F.lit("\n"), F.lit(" ")).alias(
            "assistant_preview"
        ),
    )


def normalized_confusion(confusion: DataFrame) -> DataFrame:
    """Row-normalised confusion (window over the sparse cells only)."""
    tot = F.sum("n").over(Window.partitionBy("true_tag"))
    return confusion.withColumn("share", safe_divide(F.col("n"), tot))


def active_confusion(confusion: DataFrame) -> DataFrame:
    """Only rows and columns with a non-zero total - the sparse cells
    with ``n > 0`` already are exactly that."""
    return confusion.where(F.col("n") > 0)


def tags_by_support(per_tag_df: DataFrame) -> DataFrame:
    """Per-tag metrics, support descending (tag breaks ties)."""
    return per_tag_df.orderBy(F.desc("support"), F.asc("tag"))


def tags_to_inspect(per_tag_df: DataFrame, requested: Sequence[str] | None, max_tags: int) -> list[str]:
    """The requested tags cut to ``max_tags``, else the top tags by
    (support, f1)."""
    if requested:
        return list(requested)[:max_tags]
    rows = per_tag_df.orderBy(F.desc("support"), F.desc("f1"), F.asc("tag")).limit(max_tags).collect()
    return [r["tag"] for r in rows]


def primary_for_labels(tags_col: Column, class_names: Sequence[str], support: dict[str, int]) -> Column:
    """The row's tag with the highest support (ties to the first in class
    order), or ``"unlabeled"``.  Support is a bounded per-tag map."""
    order = {t: i for i, t in enumerate(class_names)}
    keyed = F.filter(
        F.transform(
            tags_col,
            lambda t: F.struct(
                (-F.coalesce(F.try_element_at(F.create_map(*[x for k, v in support.items() for x in (F.lit(k), F.lit(v))]), t), F.lit(0))).alias("s"),
                F.try_element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), t).alias("o"),
                t.alias("t"),
            ),
        ),
        lambda s: s["o"].isNotNull(),
    )
    best = F.array_min(keyed)
    return F.coalesce(best["t"], F.lit("unlabeled"))
