"""Token counts: overlap resynchronisation for huge documents.

A document of more than ``chunk_chars`` code points is encoded in overlapping
chunks, with offsets.  Two neighbouring chunks are spliced at a proven stable
common boundary inside their overlap: a position where both encodings start
the same token, no token or special string reaches over, and that is either

* a word boundary of the vocabulary's pattern whatever stands around it: after
  white space, after a digit or before one, after a letter that no letter
  follows; or
* inside a run of letters or of symbols, where the left encoding holds the token before the
  position and the token after it side by side.  Tokens of a pair encoding are
  the encoding of their text exactly if every two neighbours are, so the left
  tokens before the position and the right tokens from it on are that too.

Tokens before it are taken from the left chunk, the others from the right one.
Where no such boundary exists the overlap is doubled, up to the whole left
chunk, which then grows by the next one (a chunk of white space, or of marks).
Otherwise memory is bound by a chunk and its overlap, not by the document.

Shorter documents are encoded whole; the counts of their pieces between
spaces are remembered in a bounded memory (see :class:`WordCounter`).

No shuffle: one pass over the texts.  Edge cases: null text is empty (0 bytes,
0 tokens); other columns pass by whatever their names; the table may be empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import WordCounter, tokenizer_path, word_counter

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
LIMIT = 2_048


#: kinds of characters are taken from a version that all regex engines know
_kind = unicodedata.ucd_3_2_0.category


def _splittable(text: str, p: int, specials: list[str]) -> bool:
    """Neither normalisation nor a special string reaches over position ``p``,
    and it is a word boundary or lies inside a run of letters or of symbols."""
    a, b = text[p - 1], text[p]
    if any(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in specials):
        return False
    if a in " \n":
        return True
    kind = _kind(b)
    if kind[0] in "MC" or unicodedata.combining(b) or not unicodedata.is_normalized("NFC", a + b):
        return False
    return _kind(a)[0] == "L" or "Nd" in (_kind(a), kind) or (_kind(a)[0] in "PS" and kind[0] in "PS")


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]


def common_boundary(text: str, left: Tokens, right: Tokens, start: int, end: int, specials: list[str]) -> int | None:
    """A stable boundary in ``text[start:end]``, within the overlap of two
    chunks but not at its very start, for their tokens' ids, starts and ends
    (positions in ``text``).  None if there is no such place."""

    def clear(tokens: Tokens) -> np.ndarray:
        """Places of the tokens that no earlier token reaches over."""
        reach = np.maximum.accumulate(np.concatenate([[0], tokens[2][:-1]]))
        new = np.concatenate([[True], tokens[1][1:] > tokens[1][:-1]])
        return np.nonzero((reach <= tokens[1]) & new & (tokens[1] >= start) & (tokens[1] < end))[0]

    if not len(left[0]) or not len(right[0]):
        return None
    # the left chunk's last token may end only because the chunk does
    i, j = clear(left), clear(right)
    i = i[left[2][i] < end]
    _, x, y = np.intersect1d(left[1][i], right[1][j], return_indices=True)
    for a, b in zip(i[x], j[y]):
        if left[0][a] == right[0][b] and left[2][a] == right[2][b] and _splittable(text, int(left[1][a]), specials):
            return int(left[1][a])
    return None


def count_huge(text: str, counter: WordCounter, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    n = len(text)
    specials = [t.content for t in counter.tokenizer.get_added_tokens_decoder().values()]

    def encode(a: int, b: int) -> Tokens:
        e = counter.tokenizer.encode(text[a:b], add_special_tokens=False)
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + a
        return np.array(e.ids, dtype=np.int64), spans[:, 0], spans[:, 1]

    begin, end, done, total = 0, min(n, chunk), 0, 0
    left = encode(begin, end)
    while end < n:
        wide = overlap
        while True:
            wide = min(wide, end - begin)
            start, stop = end - wide, min(n, end - wide + chunk + wide)
            right = encode(start, stop)
            at = common_boundary(text, left, right, max(start + 1, done), end, specials)
            if at is not None:
                break
            if wide == end - begin:  # nothing in the whole left chunk: it grows by the next
                end = stop
                left = encode(begin, end)
                if end == n:
                    break
                wide = overlap
            else:
                wide *= 2
        if at is None:
            break
        total += int(np.count_nonzero((left[1] >= done) & (left[1] < at)))
        done, begin, end, left = at, start, stop, right
    return total + int(np.count_nonzero(left[1] >= done))


def count_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = word_counter(path)
        for b in batches:
            counts = [
                counter.count(t) if len(t) <= chunk_chars else count_huge(t, counter, chunk_chars, overlap_chars)
                for t in b["__text"]
            ]
            yield pd.DataFrame({id_col: b[id_col], "n_bytes": b["n_bytes"], "n_tokens": counts})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def token_counts_query(docs: DataFrame) -> DataFrame:
    out = count_tokens(docs, tokenizer_path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
