"""Text-shape features as Spark column expressions.

Every feature is a built-in expression (``regexp_count``, ``rlike``, ``split``,
higher-order ``filter``), so the whole feature vector is evaluated inside
whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regex as rx

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_divide(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den``, or 0.0 when the denominator is 0."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def f1(precision: ColumnOrName, recall: ColumnOrName) -> Column:
    p, r = _c(precision), _c(recall)
    return safe_divide(2 * p * r, p + r)


def word_count(text: ColumnOrName) -> Column:
    """Number of maximal word-character runs."""
    return F.regexp_count(_c(text), F.lit(f"{rx.WORD_RUN}+")).cast("long")  # possessive: no way back is kept


def opening(text: ColumnOrName) -> Column:
    return F.substring(_c(text), 1, rx.OPENING_CHARS)


def _holds_none(text: Column, phrases: list[str]) -> Column:
    """Whether no phrase can occur, by plain substring search of the lower-cased
    text; false too if a letter occurs that only the pattern takes for an
    ASCII one."""
    shortest = [p for p in phrases if not any(q != p and q in p for q in phrases)]
    low = F.lower(text)
    found = low.contains(shortest[0])
    for p in shortest[1:]:
        found = found | low.contains(p)
    for ch in rx.ODD_LETTERS:
        found = found | text.contains(ch)
    return ~found


def phrase_flag(text: ColumnOrName, phrases: list[str], opening_only: bool = False) -> Column:
    """1.0 when any phrase occurs as whole words (case-insensitive)."""
    if opening_only:
        return opening(text).rlike(rx.java_phrases(phrases)).cast("double")
    t = _c(text)
    return F.when(_holds_none(t, phrases), F.lit(0.0)).otherwise(t.rlike(rx.java_phrases(phrases)).cast("double"))


def phrase_count(text: ColumnOrName, phrases: list[str]) -> Column:
    """Number of non-overlapping whole-word phrase matches."""
    t = _c(text)
    return F.when(_holds_none(t, phrases), F.lit(0.0)).otherwise(F.regexp_count(t, F.lit(rx.java_phrases(phrases))).cast("double"))


def list_format_flag(text: ColumnOrName) -> Column:
    return _c(text).rlike(rx.java_list_line_anywhere()).cast("double")


def code_fence_flag(text: ColumnOrName) -> Column:
    return (F.instr(_c(text), rx.CODE_FENCE) > 0).cast("double")


def code_fence_count(text: ColumnOrName) -> Column:
    return F.regexp_count(_c(text), F.lit("`{3}")).cast("double")


def sentence_count(text: ColumnOrName) -> Column:
    """``max(1, runs of .!? followed by whitespace or the end)``."""
    return F.greatest(F.lit(1), F.regexp_count(_c(text), F.lit(rx.SENTENCE_END_JAVA))).cast("long")


def non_blank_lines(text: ColumnOrName) -> Column:
    """Lines as ``str.splitlines`` gives them, blank ones dropped."""
    return F.filter(F.split(_c(text), rx.LINE_BREAK), lambda line: line.rlike(rx.NON_WS))


# A non-blank line is counted by its first visible character; a list line starts (after in-line spaces) with a list
# marker.  Counting them with one regex each avoids building line arrays.
NON_BLANK_LINE = f"(?:\\A|[{rx.LB_CHARS}]){rx.WS_IN_LINE}*+{rx.NON_WS}"  # its start up to that character
LIST_LINE = f"(?:\\A|(?<=[{rx.LB_CHARS}])){rx.WS_IN_LINE}*(?:[-*]|\\p{{Nd}}+[.)]){rx.WS_IN_LINE}+"


def non_blank_line_count(text: ColumnOrName) -> Column:
    return F.regexp_count(_c(text), F.lit(NON_BLANK_LINE)).cast("long")


def line_count(text: ColumnOrName) -> Column:
    """``max(1, non-blank lines)``."""
    return F.greatest(F.lit(1), non_blank_line_count(text)).cast("long")


def list_line_count(text: ColumnOrName) -> Column:
    return F.regexp_count(_c(text), F.lit(LIST_LINE)).cast("long")


def paragraph_count(text: ColumnOrName) -> Column:
    parts = F.split(_c(text), f"\\n{rx.WS}*\\n")
    return F.greatest(F.lit(1), F.size(F.filter(parts, lambda p: p.rlike(rx.NON_WS)))).cast("long")


def strip(text: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove the full Unicode whitespace set."""
    return F.regexp_replace(_c(text), f"^{rx.WS}+|{rx.WS}+\\z", "")


def char_count(text: ColumnOrName) -> Column:
    return F.length(_c(text)).cast("long")


# --------------------------------------------------------------------------
# Feature sets
# --------------------------------------------------------------------------
CLUSTER_FEATURES = [
    "log_words",
    "log_chars",
    "list_format",
    "code_block",
    "refusal_marker",
    "politeness_marker",
    "assist_agreement_opening",
    "information_agreement_opening",
    "user_validation_opening",
    "clarification_or_uncertainty",
]

CLASSIFIER_FEATURES = [
    "log_words",
    "log_chars",
    "words_per_sentence",
    "chars_per_word",
    "line_count",
    "paragraph_count",
    "list_line_fraction",
    "list_format",
    "code_block_count",
    "code_block",
    "boundary_disclaimer_marker",
    "politeness_marker",
    "assist_agreement_opening",
    "information_agreement_opening",
    "user_validation_opening",
    "hedging_rate",
    "clarification_or_uncertainty",
    "enumeration_signal_rate",
    "action_signal_rate",
    "revision_signal_rate",
]


def cluster_feature_columns(text: ColumnOrName) -> list[Column]:
    """The 10 clustering features; word and char counts are *not* floored."""
    t = _c(text)
    return [
        F.log1p(word_count(t).cast("double")).alias("log_words"),
        F.log1p(char_count(t).cast("double")).alias("log_chars"),
        list_format_flag(t).alias("list_format"),
        code_fence_flag(t).alias("code_block"),
        phrase_flag(t, rx.REFUSAL).alias("refusal_marker"),
        phrase_flag(t, rx.POLITENESS_CLUSTER).alias("politeness_marker"),
        phrase_flag(t, rx.ASSIST_OPENING, True).alias("assist_agreement_opening"),
        phrase_flag(t, rx.INFORMATION_OPENING, True).alias("information_agreement_opening"),
        phrase_flag(t, rx.VALIDATION_OPENING, True).alias("user_validation_opening"),
        phrase_flag(t, rx.CLARIFICATION).alias("clarification_or_uncertainty"),
    ]


def with_classifier_features(df, text: str = "assistant_output", prefix: str = ""):
    """Add the 20 classifier features as double columns.

    Word and char counts are floored at 1 here (unlike X6).  The intermediate
    counts are materialised once as helper columns so the regexes run once per
    row, then dropped.
    """
    t = F.col(text)
    tmp = {
        "__w": F.greatest(F.lit(1), word_count(t)).cast("double"),
        "__c": F.greatest(F.lit(1), char_count(t)).cast("double"),
        "__lines": line_count(t).cast("double"),
    }
    df = df.withColumns(tmp)
    lines_n = F.col("__lines")
    list_lines = list_line_count(t).cast("double")
    w, c = F.col("__w"), F.col("__c")
    feats = {
        "log_words": F.log1p(w),
        "log_chars": F.log1p(c),
        "words_per_sentence": w / sentence_count(t).cast("double"),
        "chars_per_word": c / w,
        "line_count": lines_n,
        "paragraph_count": paragraph_count(t).cast("double"),
        "list_line_fraction": list_lines / lines_n,
        "list_format": list_format_flag(t),
        "code_block_count": code_fence_count(t),
        "code_block": code_fence_flag(t),
        "boundary_disclaimer_marker": phrase_flag(t, rx.REFUSAL),
        "politeness_marker": phrase_flag(t, rx.POLITENESS_CLASSIFIER),
        "assist_agreement_opening": phrase_flag(t, rx.ASSIST_OPENING, True),
        "information_agreement_opening": phrase_flag(t, rx.INFORMATION_OPENING, True),
        "user_validation_opening": phrase_flag(t, rx.VALIDATION_OPENING, True),
        "hedging_rate": phrase_count(t, rx.HEDGING) / w,
        "clarification_or_uncertainty": phrase_flag(t, rx.CLARIFICATION),
        "enumeration_signal_rate": phrase_count(t, rx.ENUMERATION) / w,
        "action_signal_rate": phrase_count(t, rx.ACTION) / w,
        "revision_signal_rate": phrase_count(t, rx.REVISION) / w,
    }
    df = df.withColumns({prefix + k: v for k, v in feats.items()})
    return df.drop(*tmp.keys())


def term_tokens(text: ColumnOrName) -> Column:
    """Lower-cased maximal word runs made only of a-z, length >= 2,
    stopwords removed.  Returns ``array<string>``."""
    runs = F.regexp_extract_all(F.lower(_c(text)), F.lit(rx.WORD_RUN), 0)
    stop = F.array(*[F.lit(s) for s in rx.STOPWORDS])
    return F.filter(runs, lambda tok: tok.rlike("^[a-z]{2,}$") & ~F.array_contains(stop, tok))


def is_term(token: ColumnOrName) -> Column:
    """X8 for one exploded word run: two or more of a-z and no stop word."""
    return _c(token).rlike("^[a-z]{2,}$") & ~_c(token).isin(*rx.STOPWORDS)


def slugify(value: ColumnOrName) -> Column:
    """Non ``[a-zA-Z0-9_-]`` runs to ``_``, edge underscores trimmed, lower."""
    s = F.regexp_replace(_c(value), "[^a-zA-Z0-9_-]+", "_")
    return F.lower(F.regexp_replace(s, "^_+|_+$", ""))
