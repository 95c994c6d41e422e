"""Toxicity: multiple-instance learning with noisy-or.

A document is a bag of sentences.  A sentence is toxic with probability
``p = sigmoid(b + sum of its features' weights)``, and a document if any of its
sentences is: ``P = 1 - prod(1 - p)``.  Only documents carry labels, so the
weights are those that make the documents' labels likeliest under ``P`` (with
a normal prior); scoring a text then also tells which sentences offend.

The features of a sentence are the byte n-grams of its lower-cased words, with
a word's start and end, as a set hashed to ``2**BITS`` slots.  The slots used
are the ``N_FEATURES`` with the largest G statistic of presence in a document
against its label, counted over all learning documents.  Texts are read in
batches: one rolling hash gives the n-grams of all their sentences.

Training is spread over the rows: the learning documents are written once as
the slots of each sentence, every task adds up the gradient and the expected
information of its documents, these are summed up a tree, and the driver, which
holds ``N_FEATURES`` weights and the matrix of their squared size, takes Fisher
scoring steps until a step gains less than ``TOLERANCE``; an unfinished fit
raises an error.  All learning rows take part.  Scoring is one pass over all
texts without a shuffle.

Sentences end at ``.``, ``!``, ``?`` or a line feed; words are runs of ASCII
letters and characters outside ASCII; a sentence has at least one word, and
sentences with the same words in the same order count once a document.

Edge cases: null and empty texts have no sentence and score 0; without any
learning row every text scores 0; a document is labelled toxic if any of its
label rows says so, rows without label are not learned from; repeated documents
are rows of their own; tables may be empty; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FAN_IN, LOWER, UPPER, cut_lineage, release, tree_sum

BITS = 20
N_FEATURES = 512
#: documents of the learning rows that must hold a feature
LEAST_DOCS = 3
#: bytes of an n-gram
GRAMS = (4, 5, 6)
#: variance of the weights' prior
PRIOR = 1.0
#: log likelihood that the next step would gain at which the fit is finished
TOLERANCE = 0.01
MAX_STEPS = 100
ROWS_PER_PART = 5_000
THRESHOLD = 0.7
#: a sentence at least as likely toxic as this is reported
OFFENDING = 0.5
#: label rows that are broadcast; more are joined by a shuffle
BROADCAST_ROWS = 2_000_000

SENTENCE = re.compile(r"[^.!?\n]+")
_LETTERS = (UPPER + LOWER).encode() + bytes(range(0x80, 0x100))
_SPACED = bytes(c if c in _LETTERS else 0x20 for c in range(256))
#: bytes of sentences that are hashed at a time, if no single one is longer
_BYTES = 1 << 20


def words_of(sentence: str) -> bytes:
    """The words of a sentence, spaced as they stand."""
    return sentence.lower().encode("utf-8", "surrogatepass").translate(_SPACED).strip()


def sentences(text: str | None) -> dict[bytes, None]:
    """The different sentences of a text."""
    found = dict.fromkeys(map(words_of, SENTENCE.findall(text or "")))
    found.pop(b"", None)
    return found


def slots(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slot and place in ``own`` of every n-gram (of ``GRAMS`` bytes) that lies in
    one word with, at most, the space on either side."""
    flat = np.frombuffer(b" " + b" \n ".join(own) + b" " * max(GRAMS), np.uint8)
    lengths = np.array([len(s) for s in own], np.int64) + 3
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letter = np.concatenate([[0], np.cumsum(flat > 0x20)])
    rolled = np.zeros(len(flat), np.uint32)
    all_slots, all_at = [], []
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled[: len(flat) - n + 1] * np.uint32(0x01000193) + flat[n - 1 :]
        if n not in GRAMS:
            continue
        h = rolled
        at = np.flatnonzero(letter[n - 1 : len(h) + n - 1] - letter[1 : len(h) + 1] == n - 2)
        mixed = (h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        all_slots.append((mixed >> np.uint32(32 - BITS)).astype(np.int64))
        all_at.append(at + 1)  # its second byte is in a word
    at = np.concatenate(all_at)
    return np.concatenate(all_slots), np.searchsorted(starts, at, side="right") - 1


def in_batches(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Sentences of the texts with their text's number, a bounded part at a time."""
    number, own, size = [], [], 0
    for i, text in enumerate(texts):
        for s in sentences(text):
            if own and size + len(s) > _BYTES:
                yield number, own
                number, own, size = [], [], 0
            number.append(i)
            own.append(s)
            size += len(s)
    if own:
        yield number, own


def known_slots(own: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence and place of every feature that has a place, each once a
    sentence and in order."""
    slot, sentence = slots(own)
    at = place[slot]
    hit = at >= 0
    return np.divmod(np.unique(sentence[hit] * len(place) + at[hit]), len(place))


def places_of(chosen: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    return place


# --- features that tell the labels apart ---------------------------------------


def feature_counts(rows: DataFrame) -> DataFrame:
    """``feature, toxic, clean``: in how many documents of ``text, toxic``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        last = np.full(1 << BITS, -1, np.int64)  # the last document with a slot
        document = 0
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                for _, own in in_batches([text]):
                    slot = slots(own)[0]
                    new = slot[last[slot] != document]
                    mark = -2 - np.arange(len(new))
                    last[new] = mark
                    new = new[last[new] == mark]  # one of a slot's n-grams
                    last[new] = document
                    counts[toxic][new] += 1
                document += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pd.DataFrame({"feature": at, "clean": counts[0, at], "toxic": counts[1, at]})

    parts = rows.select("text", "toxic").mapInPandas(run, "feature long, clean long, toxic long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_features(counts: DataFrame, n_toxic: int, n_clean: int, n_features: int = N_FEATURES) -> np.ndarray:
    """The slots with the largest G statistic, ties to the smaller slot."""
    n = n_toxic + n_clean

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    held = F.col("toxic") + F.col("clean")
    g = sum(
        cell(seen, side * total / n)
        for total, here in ((n_toxic, F.col("toxic")), (n_clean, F.col("clean")))
        for seen, side in ((here, held), (total - here, n - held))
    )
    best = counts.where(held >= LEAST_DOCS).select("feature", F.round(g, 9).alias("g")).orderBy(F.desc("g"), "feature").limit(n_features)
    return np.sort(np.array([r["feature"] for r in best.collect()], np.int64))


# --- training --------------------------------------------------------------------


def bags(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``toxic, n_plain, sizes, at``: the places in ``chosen`` of the features
    of every different sentence (``sizes`` of them each, both as 16-bit
    numbers), and how many different sentences have none."""
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = places_of(shared.value)
        for b in batches:
            plain = np.zeros(len(b), np.int64)
            sizes: list[list[bytes]] = [[] for _ in range(len(b))]
            found: list[list[bytes]] = [[] for _ in range(len(b))]
            for number, own in in_batches(b["text"].tolist()):
                sentence, at = known_slots(own, place)
                n = np.bincount(sentence, minlength=len(own))
                number = np.array(number)
                np.add.at(plain, number[n == 0], 1)
                cuts = np.cumsum(n)
                firsts = np.flatnonzero(np.diff(number, prepend=-1))
                for first, last in zip(firsts, np.append(firsts[1:], len(own)) - 1):
                    i = number[first]
                    some = n[first : last + 1]
                    sizes[i].append(some[some > 0].astype("<u4").tobytes())
                    found[i].append(at[cuts[first] - n[first] : cuts[last]].astype("<u2").tobytes())
            yield pd.DataFrame({"toxic": b["toxic"], "n_plain": plain, "sizes": [b"".join(x) for x in sizes], "at": [b"".join(x) for x in found]})

    return rows.select("text", "toxic").mapInPandas(run, "toxic int, n_plain long, sizes binary, at binary")


def likelihood(w: np.ndarray, b: pd.DataFrame, information: bool = True) -> np.ndarray:
    """The bags' negative log likelihood, then its gradient (bias last) and
    expected information, row by row."""
    k, n = len(w), len(b)
    counts = np.array([len(s) // 4 for s in b["sizes"]], np.int64)
    sizes = np.frombuffer(b"".join(b["sizes"]), "<u4").astype(np.int64)
    at = np.frombuffer(b"".join(b["at"]), "<u2").astype(np.int64)
    bag = np.repeat(np.arange(n), counts)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    plain, toxic = b["n_plain"].to_numpy(float), b["toxic"].to_numpy() == 1
    z = w[-1] + np.bincount(sentence, weights=w[at], minlength=len(sizes))
    clean = -np.logaddexp(0, z)  # log(1 - p)
    none = np.bincount(bag, weights=clean, minlength=n) - plain * np.logaddexp(0, w[-1])  # log(1 - P)
    some = np.log(-np.expm1(np.minimum(none, -1e-12)))  # log P
    out = np.zeros(1 + k + k * k)
    out[0] = -np.where(toxic, some, none).sum()
    p = np.exp(z + clean)
    v = np.bincount(bag[sentence] * k + at, weights=p[sentence], minlength=n * k).reshape(n, k)  # gradient of -log(1 - P)
    v[:, -1] = np.bincount(bag, weights=p, minlength=n) + plain * math.exp(w[-1] - np.logaddexp(0, w[-1]))
    odds = np.exp(np.minimum(none - some, 30.0))  # (1 - P) / P
    out[1 : 1 + k] = v.T @ np.where(toxic, -odds, 1.0)
    if information:
        out[1 + k :] = ((v * odds[:, None]).T @ v).ravel()
    return out


def fisher_scoring(value, w: np.ndarray, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> np.ndarray:
    """The weights that minimise ``value(w, information)``, which returns the
    loss, its gradient and a positive definite information matrix: full steps,
    halved while the loss doesn't fall."""
    loss, g, h = value(w, True)
    for _ in range(max_steps):
        step = -np.linalg.solve(h, g)
        gain = -(g @ step) / 2
        if gain <= tolerance:
            return w
        size = 1.0
        while value(w + size * step, False)[0] > loss - 2e-4 * size * gain:
            size /= 2
            if size < 1e-9:
                raise RuntimeError("the fit found no smaller loss")
        w = w + size * step
        loss, g, h = value(w, True)
    raise RuntimeError(f"the fit did not end within {max_steps} steps")


class Model:
    """Chosen slots, their weights and the bias of a sentence; no slots and no
    bias stand for a table without learning rows."""

    def __init__(self, chosen: np.ndarray, w: np.ndarray | None):
        self.chosen, self.weights, self.bias = chosen, w[:-1] if w is not None else None, w[-1] if w is not None else None


def fit(rows: DataFrame, n_features: int = N_FEATURES) -> Model:
    """From all rows of ``text, toxic`` (0 or 1)."""
    spark = rows.sparkSession
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if sums["n"] == 0:
        return Model(np.zeros(0, np.int64), None)
    chosen = choose_features(feature_counts(rows), sums["toxic"], sums["n"] - sums["toxic"], n_features)
    n_parts = math.ceil(sums["n"] / ROWS_PER_PART)
    table = cut_lineage(bags(rows, chosen).repartition(n_parts))
    k = len(chosen) + 1

    def value(w: np.ndarray, information: bool) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + k + k * k)
            for b in batches:
                total += likelihood(w, b, information)
            total = total if information else total[: 1 + k]
            yield pd.DataFrame({"bucket": [0], "part": [TaskContext.get().partitionId()], "vector": [total.tobytes()]})

        partials = table.coalesce(n_parts).mapInPandas(run, "bucket long, part long, vector binary")
        total = sum(np.frombuffer(r["vector"], "<f8") for r in tree_sum(partials, "<f8", n_parts, FAN_IN).collect())
        away = np.append(w[:-1], w[-1] - start[-1])
        h = total[1 + k :].reshape(k, k) + np.eye(k) / PRIOR if information else None
        return total[0] + (away @ away) / (2 * PRIOR), total[1 : 1 + k] + away / PRIOR, h

    n_sentences = table.agg(F.sum(F.col("n_plain") + F.octet_length("sizes") / 4)).first()[0]
    rate = min((sums["toxic"] + 0.5) / (n_sentences + 1.0), 0.5)
    start = np.append(np.zeros(len(chosen)), math.log(rate / (1 - rate)))
    w = fisher_scoring(value, start)
    release(table)
    return Model(chosen, w)


# --- scoring ---------------------------------------------------------------------


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score``, ``n_sentences`` (different ones) and ``offending``:
    start, end (code points) and probability of the sentences likely toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        place = places_of(model.chosen)
        for b in batches:
            texts = b["__text"].tolist()
            clean, counts = np.zeros(len(b)), np.zeros(len(b), np.int64)
            likely: dict[int, dict[bytes, float]] = {}
            for number, own in in_batches(texts) if model.bias is not None else ():
                sentence, at = known_slots(own, place)
                z = model.bias + np.bincount(sentence, weights=model.weights[at], minlength=len(own))
                np.add.at(clean, number, np.logaddexp(0, z))
                np.add.at(counts, number, 1)
                for i in np.flatnonzero(z >= _LEAST_Z):
                    likely.setdefault(number[i], {})[own[i]] = 1 / (1 + math.exp(-z[i]))
            found = [
                [{"start": m.start(), "end": m.end(), "score": own[w]} for m in SENTENCE.finditer(text) if (w := words_of(m[0])) in own] if own else []
                for text, own in ((t, likely.get(i)) for i, t in enumerate(texts))
            ]
            yield pd.DataFrame({id_col: b[id_col], "score": -np.expm1(-clean), "n_sentences": counts, "offending": found})

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInPandas(run, schema)


_LEAST_Z = math.log(OFFENDING / (1 - OFFENDING))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of the documents that have a label and are not held out."""
    own = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = cut_lineage(own.where(F.col("doc_id").isNotNull()))
    if own.count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    return docs.where(~held_out()).select("doc_id", "text").join(own, "doc_id").select("text", "toxic")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(learning_rows(docs, labels)))
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_sentences", "offending"
    )
