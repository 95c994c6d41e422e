"""Quality rules: a learned decision list (DataFrame functions only).

Sequential covering over labelled statistics.  Every document gets a row of
interpretable measures in one native pass over its whole text.  On the
labelled rows, a rule starts empty and is grown by the threshold condition
with the largest information gain, judged on counts per (measure, bin, label)
that Spark aggregates over all labelled rows not yet covered; it is then
pruned to the prefix that does best on a held-back third, and accepted if it
is precise enough there.  Covered rows leave, the next rule follows.  The list
is emitted as one ordered Spark conditional expression.

Only aggregated counts (measures x thresholds) reach the driver.

Edge cases: a null text has no words, so it fails the base check; without
labels, or with labels of one class only, the list is empty and the base check
decides alone; labels that are null are ignored; repeated label rows count as
often as they occur; tables may be empty and may carry further columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, strip_ws, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_IDX_BITS = 24
_PREFIX = ~((1 << _IDX_BITS) - 1)

MEASURES = [
    "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share",
    "distinct_share", "mean_word_chars", "mean_line_words",
]


def _removed(text: Column, pattern: str) -> Column:
    """How many code points the pattern's matches take."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and
    the measures the rules use, one row per document row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    # three-word windows: a 64-bit hash each, of which the upper 40 bits and the position sort as one long
    d = d.withColumn(
        "grams",
        F.when(
            F.size("words") >= 3,
            F.zip_with(
                F.zip_with(
                    F.slice("words", 1, F.size("words") - 2), F.slice("words", 2, F.size("words") - 2),
                    lambda a, b: F.struct(a.alias("a"), b.alias("b")),
                ),
                F.slice("words", 3, F.size("words") - 2),
                lambda ab, c: F.xxhash64(ab["a"], ab["b"], c),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.withColumn("keys", F.sort_array(F.transform("grams", lambda h, i: h.bitwiseAND(F.lit(_PREFIX)).bitwiseOR(i.cast("long")))))
    n = F.size("keys")

    def idx(k: Column) -> Column:
        return k.bitwiseAND(F.lit((1 << _IDX_BITS) - 1)).cast("int")

    def same_prefix(a: Column, b: Column) -> Column:
        return a.bitwiseAND(F.lit(_PREFIX)) == b.bitwiseAND(F.lit(_PREFIX))

    # neighbours in key order that share the prefix: (position, position, full hashes equal)
    pairs = F.when(
        n >= 2,
        F.filter(
            F.zip_with(
                F.slice("keys", 1, n - 1), F.slice("keys", 2, n - 1),
                lambda a, b: F.when(same_prefix(a, b), F.struct(idx(a).alias("a"), idx(b).alias("b"))),
            ),
            lambda p: p.isNotNull(),
        ),
    ).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    d = d.withColumn("pairs", pairs)
    at = lambda i: F.get(F.col("grams"), i)
    clash = F.exists("pairs", lambda p: at(p["a"]) != at(p["b"])) | (F.size("grams") >= (1 << _IDX_BITS))
    # unequal windows with equal prefixes (about 1 in 10^4 texts of 20,000 words, a third of those of 10^6) or more
    # positions than the bits hold: the windows are sorted by the whole hash
    whole = F.when(clash, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("whole", whole)
    again = F.zip_with(
        F.slice("whole", 1, F.size("whole") - 1), F.slice("whole", 2, F.size("whole") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.when(F.col("whole").isNotNull(), F.flatten(again)).when(
        F.size("pairs") == 0, F.array().cast("array<int>")
    ).otherwise(F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"]))))
    d = d.withColumn("starts", starts)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.array(i, i + 1, i + 2))))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.length(strip_ws(x)) > 0)
    d = d.withColumn("lines", lines)
    long = lambda c: c.cast("long")
    d = d.select(
        "id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        _removed(F.col("text"), "[#*$%&|<>]").alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.size(covered)).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_text_lines"),
        long(F.size(F.array_distinct("words"))).alias("n_distinct"),
        _removed(F.col("text"), "\\p{Lu}").alias("n_upper"),
        _removed(F.col("text"), "[!?]").alias("n_marks"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "upper_share": share("n_upper", "word_chars"),
            "mark_share": share("n_marks", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_text_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "distinct_share": share("n_distinct", "n_words"),
            "mean_word_chars": share("word_chars", "n_words"),
            "mean_line_words": share("n_words", "n_text_lines"),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.measure)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


def all_of(conditions: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in conditions])


@dataclass
class DecisionList:
    """Ordered rules; each sends the rows it covers to ``kept = false``."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        expr = None
        for rule in self.rules:
            expr = F.when(all_of(rule), F.lit(False)) if expr is None else expr.when(all_of(rule), F.lit(False))
        return F.lit(True) if expr is None else expr.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(["drop if " + " and ".join(map(str, r)) for r in self.rules] + ["otherwise keep"])


def _thresholds(train: DataFrame, bins: int) -> dict[str, list[float]]:
    """Cut points per measure: half way between neighbouring quantiles of either
    class (both sides of a rare class are then equally well resolved, and a
    cut keeps its distance from the values of both)."""
    at = [i / bins for i in range(1, bins)]
    rows = train.groupBy("bad").agg(*[F.percentile_approx(m, at, 2000).alias(m) for m in MEASURES]).collect()
    values = {m: sorted({float(v) for r in rows for v in (r[m] or [])}) for m in MEASURES}
    return {m: sorted({(a + b) / 2 for a, b in zip(v, v[1:])}) for m, v in values.items()}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    if p == 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def fit_decision_list(
    labelled: DataFrame,
    bins: int = 16,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 5,
) -> DecisionList:
    """``labelled`` holds ``id``, ``bad`` (boolean) and the measures.

    All labelled rows count.  ``max_rules`` and ``max_conditions`` bound the
    size of the model, not the rows it sees.
    """
    train = cut_lineage(labelled.select("id", "bad", *MEASURES).where(F.col("bad").isNotNull()))
    cuts = _thresholds(train, bins)
    held_back = F.pmod(F.xxhash64("id"), F.lit(3)) == 0

    def bin_of(m: str) -> Column:
        """Number of cut points below the value."""
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[m]]), lambda c: c < F.col(m)))

    usable = [m for m in MEASURES if cuts[m]]
    binned = train.withColumn("grow", ~held_back)
    if usable:
        binned = binned.withColumn("bins", F.array(*[bin_of(m) for m in usable]))
    binned = cut_lineage(binned)
    found = DecisionList()
    rest = binned
    while usable and len(found.rules) < max_rules:
        rule: list[Condition] = []
        grown = rest.where("grow")
        while len(rule) < max_conditions:
            here = grown.where(all_of(rule)) if rule else grown
            counts = (
                here.select("bad", F.posexplode("bins").alias("m", "bin"))
                .groupBy("m", "bin")
                .agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count(F.lit(1)).alias("all"))
                .collect()
            )
            table = [[(0, 0)] * (len(cuts[m]) + 1) for m in usable]
            for r in counts:
                table[r["m"]][r["bin"]] = (r["p"], r["all"] - r["p"])
            p0, n0 = (sum(x[i] for x in table[0]) for i in (0, 1))
            if p0 == 0 or n0 == 0:
                break
            best, choice = 1e-9, None
            for k, m in enumerate(usable):
                p = n = 0
                for j, cut in enumerate(cuts[m]):
                    p, n = p + table[k][j][0], n + table[k][j][1]
                    for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if pp >= min_covered and (g := _gain(pp, nn, p0, n0)) > best:
                            best, choice = g, Condition(m, above, cut)
            if choice is None:
                break
            rule.append(choice)
        if not rule:
            break
        # prune: the prefix with the best (p - n) / (p + n) on the held-back rows
        tried = rest.where("NOT grow").agg(
            *[
                F.sum((all_of(rule[:k]) & (F.col("bad") if bad else ~F.col("bad"))).cast("long")).alias(f"{'p' if bad else 'n'}{k}")
                for k in range(1, len(rule) + 1)
                for bad in (True, False)
            ]
        ).first()
        scored = [
            ((p - n) / (p + n), k, p / (p + n))
            for k in range(1, len(rule) + 1)
            for p, n in [(tried[f"p{k}"] or 0, tried[f"n{k}"] or 0)]
            if p + n > 0
        ]
        if not scored:
            break
        _, k, precision = max(scored, key=lambda s: (s[0], -s[1]))
        if precision < min_precision:
            break
        found.rules.append(rule[:k])
        rest = rest.where(~all_of(rule[:k]))
    return found


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> tuple[DataFrame, DecisionList]:
    """Measures of every document with ``base_failed`` and ``kept``, and the
    list that decided.  ``labels``: ``id_col`` and ``quality`` (1 good, 0 bad).
    Rows that fail the base check are not used for learning: the list only
    ever decides on the others."""
    measured = cut_lineage(base_measures(docs, id_col, text_col).withColumn("base_failed", base_failed()))
    known = labels.where(F.col("quality").isNotNull()).select(
        F.col(id_col).alias("id"), (F.col("quality") == 0).alias("bad")
    )
    found = fit_decision_list(measured.where(~F.col("base_failed")).join(known, "id"), **options)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(found.verdict())
    return measured.withColumn("kept", kept), found


def quality_rules_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out, _ = quality_rules(docs, labels)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )
