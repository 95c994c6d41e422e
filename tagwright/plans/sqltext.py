"""DuckDB (RE2) renderings of the text features, for the oracle SQL.

RE2 has no look-around, so whole-word phrase matching is done by matching one
boundary character on each side; counts are taken after doubling every
non-word character, so neighbouring matches never compete for the same
boundary character.
"""

from __future__ import annotations

from ..functions import regex as rx
from ..functions.regex import sql_str

WS = rx.WS
DOUBLED = r"regexp_replace({t}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, {sql_str(f'^{WS}+|{WS}+$')}, '', 'g')"


def word_count(t: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, {sql_str(rx.WORD_RUN)})) AS BIGINT)"


def opening(t: str) -> str:
    return f"substr({t}, 1, {rx.OPENING_CHARS})"


def flag(t: str, phrases: list[str], opening_only: bool = False) -> str:
    src = opening(t) if opening_only else t
    return f"CAST(regexp_matches({src}, {sql_str(rx.re2_phrase_flag(phrases))}) AS DOUBLE)"


def count(t: str, phrases: list[str]) -> str:
    doubled = DOUBLED.format(t=t)
    return f"CAST(len(regexp_extract_all({doubled}, {sql_str(rx.re2_phrase_count(phrases))})) AS DOUBLE)"


def list_flag(t: str) -> str:
    return f"CAST(regexp_matches({t}, {sql_str(rx.re2_list_line_anywhere())}) AS DOUBLE)"


def fence_flag(t: str) -> str:
    return f"CAST(strpos({t}, '```') > 0 AS DOUBLE)"


def fence_count(t: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, '```')) AS DOUBLE)"


def sentences(t: str) -> str:
    return f"greatest(1, len(regexp_extract_all({t}, {sql_str(rx.SENTENCE_END_RE2)})))"


def lines(t: str) -> str:
    return (
        f"list_filter(string_split_regex({t}, {sql_str(rx.LINE_BREAK)}), "
        f"lambda l: regexp_matches(l, {sql_str(rx.NON_WS)}))"
    )


def line_count(t: str) -> str:
    return f"greatest(1, len({lines(t)}))"


def list_lines(t: str) -> str:
    return f"len(list_filter({lines(t)}, lambda l: regexp_matches(l, {sql_str('^' + rx.LIST_ITEM_BODY)})))"


def paragraphs(t: str) -> str:
    parts = f"string_split_regex({t}, {sql_str(chr(10) + WS + '*' + chr(10))})"
    return f"greatest(1, len(list_filter({parts}, lambda p: regexp_matches(p, {sql_str(rx.NON_WS)}))))"


def cluster_features(t: str, digits: int = 6) -> list[str]:
    """X6 as SQL select items."""
    r = lambda e: f"round({e}, {digits})"
    return [
        f"{r(f'ln(1 + {word_count(t)})')} AS log_words",
        f"{r(f'ln(1 + length({t}))')} AS log_chars",
        f"{list_flag(t)} AS list_format",
        f"{fence_flag(t)} AS code_block",
        f"{flag(t, rx.REFUSAL)} AS refusal_marker",
        f"{flag(t, rx.POLITENESS_CLUSTER)} AS politeness_marker",
        f"{flag(t, rx.ASSIST_OPENING, True)} AS assist_agreement_opening",
        f"{flag(t, rx.INFORMATION_OPENING, True)} AS information_agreement_opening",
        f"{flag(t, rx.VALIDATION_OPENING, True)} AS user_validation_opening",
        f"{flag(t, rx.CLARIFICATION)} AS clarification_or_uncertainty",
    ]


def classifier_features_cte(src: str, t: str, keys: list[str], digits: int | None = 6) -> str:
    """X7 as a SQL query over ``src`` returning ``keys`` + 20 features."""
    w = f"CAST(greatest(1, {word_count(t)}) AS DOUBLE)"
    c = f"CAST(greatest(1, length({t})) AS DOUBLE)"
    base = (
        f"SELECT {', '.join(keys)}, {t} AS __t, {w} AS __w, {c} AS __c, "
        f"CAST({line_count(t)} AS DOUBLE) AS __lines, CAST({list_lines(t)} AS DOUBLE) AS __ll FROM {src}"
    )
    r = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    tt = "__t"
    items = [
        (f"ln(1 + __w)", "log_words"),
        (f"ln(1 + __c)", "log_chars"),
        (f"__w / CAST({sentences(tt)} AS DOUBLE)", "words_per_sentence"),
        ("__c / __w", "chars_per_word"),
        ("__lines", "line_count"),
        (f"CAST({paragraphs(tt)} AS DOUBLE)", "paragraph_count"),
        ("__ll / __lines", "list_line_fraction"),
        (list_flag(tt), "list_format"),
        (fence_count(tt), "code_block_count"),
        (fence_flag(tt), "code_block"),
        (flag(tt, rx.REFUSAL), "boundary_disclaimer_marker"),
        (flag(tt, rx.POLITENESS_CLASSIFIER), "politeness_marker"),
        (flag(tt, rx.ASSIST_OPENING, True), "assist_agreement_opening"),
        (flag(tt, rx.INFORMATION_OPENING, True), "information_agreement_opening"),
        (flag(tt, rx.VALIDATION_OPENING, True), "user_validation_opening"),
        (f"{count(tt, rx.HEDGING)} / __w", "hedging_rate"),
        (flag(tt, rx.CLARIFICATION), "clarification_or_uncertainty"),
        (f"{count(tt, rx.ENUMERATION)} / __w", "enumeration_signal_rate"),
        (f"{count(tt, rx.ACTION)} / __w", "action_signal_rate"),
        (f"{count(tt, rx.REVISION)} / __w", "revision_signal_rate"),
    ]
    sel = ", ".join(f"{r(e)} AS {n}" for e, n in items)
    return f"SELECT {', '.join(keys)}, {sel} FROM ({base}) __x7"


def term_tokens(t: str) -> str:
    stop = "[" + ", ".join(sql_str(s) for s in rx.STOPWORDS) + "]"
    runs = f"regexp_extract_all(lower({t}), {sql_str(rx.WORD_RUN)})"
    return f"list_filter({runs}, lambda x: regexp_matches(x, '^[a-z]{{2,}}$') AND NOT list_contains({stop}, x))"
