"""Unicode-safe regular expressions shared by Spark (Java regex) and the
DuckDB oracle (RE2).

The behaviour to reproduce is that of Python's ``re`` on ``str`` patterns,
which is Unicode-aware by default.  Java's and RE2's defaults are not, so every
class is written out explicitly:

* a *word character* is ``[\\p{L}\\p{N}_]`` (Python ``\\w``), so ``\\b`` before
  and after an alternation becomes a negative look-behind / look-ahead on that
  class in Java.  RE2 has no look-around; the oracle matches one boundary
  character instead and, for counting, doubles every non-word character first
  so that two neighbouring matches never need the same boundary character;
* *whitespace* is Python's ``str.isspace`` set: ``\\t``-``\\r``, U+001C-U+001F,
  U+0085 and every ``\\p{Z}`` character;
* ``(?m)^`` must break lines at ``\\n`` only, which Java does with ``(?d)``;
* ``\\d`` is ``\\p{Nd}``; case-insensitive matching is Unicode-aware
  (``(?iu)`` in Java, ``(?i)`` in RE2).
"""

from __future__ import annotations

WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"
WS_CHARS = r"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}"
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"
# str.splitlines() boundaries
LINE_BREAK = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
LB_CHARS = r"\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
# whitespace that is not a line boundary: tab, U+001F, space separators
WS_IN_LINE = r"[\t\x{1f}\p{Zs}]"

# ---------------------------------------------------------------------------
# The marker phrase lists of the behaviour features.  They must
# equal the published feature definitions word for word, so they are stated
# here plainly and in their original order.
# ---------------------------------------------------------------------------
REFUSAL = ["sorry", "cannot", "can't", "unable", "not able", "i do not", "i don't"]
POLITENESS_CLUSTER = ["please", "thank", "thanks", "happy to", "glad to"]
POLITENESS_CLASSIFIER = ["please", "thank", "thanks", "happy to", "glad to", "delighted"]
ASSIST_OPENING = [
    "sure", "certainly", "of course", "absolutely", "happy to", "i can help", "i'd be happy", "i will help",
]
INFORMATION_OPENING = [
    "here is", "here are", "below is", "below are", "i can provide", "let me explain", "to answer",
    "based on", "according to",
]
VALIDATION_OPENING = [
    "i agree", "you're right", "you are right", "exactly", "that's true", "that is true", "makes sense",
    "good point",
]
HEDGING = ["may", "might", "could", "possibly", "perhaps", "it depends", "however", "although", "while"]
CLARIFICATION = [
    "could you clarify", "can you provide", "please provide", "need more information", "it depends", "may",
    "might", "could", "possibly",
]
ENUMERATION = ["first", "second", "third", "finally", "lastly", "step", "tip", "option", "example"]
ACTION = ["recommend", "suggest", "try", "consider", "use", "create", "add", "make", "follow"]
REVISION = ["revise", "updated", "version", "draft", "rewrite", "add more", "include"]

# Term tokens in cluster reports skip these words (fixed list, original order).
STOPWORDS = [
    "we", "will", "until", "they", "than", "such", "some", "should", "our", "or", "on", "of", "may", "its",
    "it", "is", "in", "if", "each", "does", "do", "by", "been", "be", "at", "as", "an", "a", "about",
    "after", "also", "and", "are", "because", "but", "can", "for", "from", "have", "how", "into", "more",
    "not", "that", "the", "their", "then", "there", "this", "to", "use", "was", "what", "when", "where",
    "which", "with", "would", "you", "your",
]

OPENING_CHARS = 180  # = defaults.OPENING_CHARS

# Line that starts a list item: optional indent, then "-", "*", "1." or "1)",
# then whitespace.
LIST_ITEM_BODY = rf"{WS}*(?:[-*]|\p{{Nd}}+[.)]){WS}+"
CODE_FENCE = "```"
SENTENCE_END_JAVA = rf"[.!?]++(?:{WS}|\z)"
SENTENCE_END_RE2 = rf"[.!?]+(?:{WS}|$)"
WORD_RUN = f"{WORD_CLASS}+"


def _alternation(phrases: list[str]) -> str:
    for p in phrases:
        if any(ch in p for ch in "\\.^$|?*+()[]{}"):
            raise ValueError(f"phrase needs escaping: {p!r}")
    return "|".join(phrases)


# Characters outside ASCII that Unicode case-insensitive matching (Python's
# re.IGNORECASE and Java's (?iu) alike) treats as ASCII letters: capital I with
# dot, dotless i, long s, Kelvin sign.  Checked over every code point.
_EXTRA_CASE = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}
ODD_LETTERS = "".join(_EXTRA_CASE.values())


def _caseless(phrase: str) -> str:
    """A phrase with every ASCII letter spelled as the class of all characters
    that match it case-insensitively, so the pattern needs no ``(?iu)`` flag
    (which makes every character comparison a Unicode case mapping)."""
    out = []
    for ch in phrase:
        if "a" <= ch.lower() <= "z":
            lo = ch.lower()
            out.append(f"[{lo}{lo.upper()}{_EXTRA_CASE.get(lo, '')}]")
        else:
            out.append(ch)
    return "".join(out)


def java_phrases(phrases: list[str]) -> str:
    """Whole-word, case-insensitive alternation for Spark (``rlike`` /
    ``regexp_count``), case folded into explicit classes."""
    _alternation(phrases)
    alts = "|".join(_caseless(p) for p in phrases)
    # a cheap first-character test before the Unicode look-behind rejects
    # most positions early
    firsts = sorted({ch for p in phrases for ch in _caseless(p[0]).strip("[]")})
    return f"(?=[{''.join(firsts)}])(?<!{WORD_CLASS})(?:{alts})(?!{WORD_CLASS})"


def java_list_line_anywhere() -> str:
    """``(?m)^`` list item anywhere in a text (lines broken at ``\\n`` only)."""
    return f"(?md)^{LIST_ITEM_BODY}"


def java_list_line_start() -> str:
    """List item at the start of one already split line."""
    return f"^{LIST_ITEM_BODY}"


# ----------------------------- RE2 (oracle) --------------------------------

def re2_phrase_flag(phrases: list[str]) -> str:
    return f"(?i)(^|{NON_WORD_CLASS})(?:{_alternation(phrases)})($|{NON_WORD_CLASS})"


def re2_phrase_count(phrases: list[str]) -> str:
    """Pattern to count on text whose non-word characters were doubled."""
    doubled = [
        "".join(ch + ch if not (ch.isalnum() or ch == "_") else ch for ch in p) for p in phrases
    ]
    return f"(?i)(^|{NON_WORD_CLASS})(?:{_alternation(doubled)})($|{NON_WORD_CLASS})"


def re2_list_line_anywhere() -> str:
    return f"(?m)^{LIST_ITEM_BODY}"


def sql_str(value: str) -> str:
    """A DuckDB / ANSI string literal."""
    return "'" + value.replace("'", "''") + "'"
