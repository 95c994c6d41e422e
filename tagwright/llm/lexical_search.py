"""Ranked lexical search by hashed max-sketches.

Index: a document's terms are hashed to two cells each of an array at least
four times as wide as it has different terms, and a cell keeps the largest
term frequency folded into it.  A term's impact
``(1000000000 * tf) div (1000 * tf + 8 * m)`` grows with ``tf`` for the
document's fixed length factor ``m``, so the smaller of a term's two cells
bounds its impact from above.  Frequencies up to 127 are kept exactly, larger
ones are rounded up; an index row doesn't depend on the queries.

Search, for a block of items: a task looks the items' terms up in the sketches
of many documents at once and gets an upper bound for every item and document.

1. The documents with the highest bounds of all (``SEEDS`` an item) are scored
   exactly; an item's tenth highest score is a first threshold.
2. In one pass over the index, every batch rescores each item's documents in
   descending order of their bounds until a bound falls below the threshold,
   which rises with the scores found.  A text is parsed only if a bound of
   its document reaches a threshold, and then from the same row of the index.
3. The tasks' best documents are merged.

A document left out has a bound, and so a score, below ten scores found, so the
result is exact.  Items are taken in blocks of about ``ITEM_BYTES`` of text;
documents are never collected, and the driver holds a block's terms, its
document frequencies and its seeds' ids.

Edge cases: null texts have no terms; items without a term have no results;
rows with equal ids are documents (or items) of their own, but equal item rows
count once; a null ``doc_id`` comes after the others of its score; tables may
be empty; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topk import top_k_per_group
from .common import LOWER, UPPER, cut_lineage, release, tree_sum

TOP = 10
SEEDS = 20
ITEM_BYTES = 1 << 20
#: cells of a sketch for each different term, at least
CELLS_PER_TERM = 4
#: values of a task's table of impacts at a time
_VALUES = 1 << 18
# Term rule and weights of the contract (fixed values)
_ALNUM = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
_READ = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or c in _ALNUM else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_READ).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, all_terms: int) -> int:
    return 25 + (75 * n * n_docs) // max(1, all_terms)


# --- sketches ------------------------------------------------------------------


def _levels() -> np.ndarray:
    """The frequencies that a byte can stand for: exact up to 127, then steps
    of an eighth of a power of two; the last one stands for all above."""
    out = list(range(128))
    while len(out) < 256:
        out.append(math.ceil(out[-1] * 2**0.125) + 1)
    return np.array(out, np.int64)


LEVELS = _levels()


def cells(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each term, to be cut to the width of a sketch."""
    h = np.fromiter((xxhash.xxh64_intdigest(t) for t in terms), np.uint64, len(terms))
    return (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64)


def sketch(counts: Counter) -> bytes:
    """The largest frequency (as a level) folded into each cell."""
    if not counts:
        return b""
    width = 1 << max(3, (CELLS_PER_TERM * len(counts) - 1).bit_length())
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    level = np.minimum(np.searchsorted(LEVELS, tf), 255).astype(np.uint8)
    first, second = cells(list(counts))
    order = np.argsort(level, kind="stable")  # of several values for a cell the last one stays
    at = np.concatenate([first[order], second[order]]) & (width - 1)
    both = np.concatenate([level[order], level[order]])
    out = np.zeros(width, np.uint8)
    last = np.argsort(both, kind="stable")
    out[at[last]] = both[last]
    return out.tobytes()


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, known, n, sketch, text``: one row a document with a term; a
    null id is 0 and not known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [Counter(terms_of(t)) for t in b["text"]]
            b["n"] = [sum(c.values()) for c in counts]
            b["sketch"] = [sketch(c) for c in counts]
            yield b.loc[b["n"] > 0, ["doc_id", "known", "n", "sketch", "text"]]

    doc_id = F.col(id_col).cast("long")
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNotNull().alias("known"), F.col(text_col).alias("text")
    )
    return rows.mapInPandas(run, "doc_id long, known boolean, n long, sketch binary, text string")


# --- a block of items --------------------------------------------------------------


class Items:
    """The items of a block: different terms of all, and per item its terms'
    places with their weights (times the term's occurrences in the item)."""

    def __init__(self, texts: list[str]):
        each = [Counter(terms_of(t)) for t in texts]
        self.terms = sorted(set().union(*each)) if each else []
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.starts = np.concatenate([[0], np.cumsum([len(c) for c in each])[:-1]]).astype(np.int64)
        self.at = np.array([self.place[t] for c in each for t in c], np.int64)
        self.times = np.array([n for c in each for n in c.values()], np.int64)
        self.first, self.second = cells(self.terms)

    def weigh(self, n_docs: int, all_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.all_terms = n_docs, all_terms
        w = np.array([weight(n_docs, int(d)) for d in df], np.int64)
        self.weights = w[self.at] * self.times

    def __len__(self) -> int:
        return len(self.starts)

    def _sums(self, impacts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(impacts[..., self.at] * self.weights, self.starts, axis=-1)

    def score(self, n: int, text: str) -> np.ndarray:
        """The exact scores of a document for all items."""
        counts = Counter(terms_of(text))
        tf = np.zeros(len(self.terms), np.int64)
        for t in counts.keys() & self.place.keys():
            tf[self.place[t]] = counts[t]
        return self._sums((1_000_000_000 * tf) // (1000 * tf + 8 * length_factor(n, self.n_docs, self.all_terms)))

    def bounds(self, ns: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        """Upper bounds of the scores: a row for each document."""
        out = np.zeros((len(ns), len(self)), np.int64)
        widths = np.array([len(s) for s in sketches])
        step = max(1, _VALUES // max(1, len(self.at)))
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            p, q = self.first & (width - 1), self.second & (width - 1)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                s = np.frombuffer(b"".join(sketches[r] for r in part), np.uint8).reshape(len(part), width)
                m = np.array([length_factor(int(ns[r]), self.n_docs, self.all_terms) for r in part], np.int64)
                impacts = (1_000_000_000 * LEVELS) // (1000 * LEVELS + 8 * m[:, None])
                impacts[:, 255] = 1_000_000
                out[part] = self._sums(np.take_along_axis(impacts, np.minimum(s[:, p], s[:, q]).astype(np.int64), axis=1))
        return out


def _document_frequencies(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    shared = index.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = shared.value
        df = np.zeros(len(place), np.int64)
        for b in batches:
            for text in b["text"]:
                for t in place.keys() & set(terms_of(text)):
                    df[place[t]] += 1
        yield pd.DataFrame({"bucket": [0], "part": [TaskContext.get().partitionId()], "vector": [df.astype("<i8").tobytes()]})

    partials = cut_lineage(index.select("text").mapInPandas(run, "bucket long, part long, vector binary"))
    n_parts = partials.agg(F.max("part")).first()[0]
    rows = tree_sum(partials, "<i8", n_parts + 1).collect()
    release(partials)
    return np.frombuffer(rows[0]["vector"], "<i8") if rows else np.zeros(len(terms), np.int64)


def _highest_bounds(index: DataFrame, shared, seeds: int) -> DataFrame:
    """``item, doc_id, score``: each task's documents with the highest bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        top = np.zeros((0, len(items)), np.int64)
        ids = np.zeros((0, len(items)), np.int64)
        for b in batches:
            bounds = items.bounds(b["n"].to_numpy(), b["sketch"].tolist())
            top = np.concatenate([top, bounds])
            ids = np.concatenate([ids, np.broadcast_to(b["doc_id"].to_numpy(np.int64)[:, None], bounds.shape)])
            if len(top) > seeds:
                keep = np.argpartition(-top, seeds - 1, axis=0)[:seeds]
                top, ids = np.take_along_axis(top, keep, 0), np.take_along_axis(ids, keep, 0)
        item = np.broadcast_to(np.arange(len(items)), top.shape)
        yield pd.DataFrame({"item": item.ravel(), "doc_id": ids.ravel(), "score": top.ravel()})

    rows = index.where("known").select("doc_id", "n", "sketch")
    return rows.mapInPandas(run, "item long, doc_id long, score long")


def _exact(rows: DataFrame, shared) -> DataFrame:
    """``item, doc_id, score`` of every row for every item, above 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        for b in batches:
            for doc_id, n, text in zip(b["doc_id"], b["n"], b["text"]):
                scores = items.score(n, text)
                at = np.flatnonzero(scores > 0)
                yield pd.DataFrame({"item": at, "doc_id": doc_id, "score": scores[at]})

    return rows.select("doc_id", "n", "text").mapInPandas(run, "item long, doc_id long, score long")


def _rescored(index: DataFrame, shared, thresholds: dict[int, int], top: int) -> DataFrame:
    """``item, doc_id, known, score``: each task's best documents that reach the
    thresholds, scored in descending order of their bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        least = np.array([max(1, thresholds.get(i, 1)) for i in range(len(items))], np.int64)
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(len(items))]
        for b in batches:
            ids, known, ns, texts = b["doc_id"].tolist(), b["known"].tolist(), b["n"].to_numpy(), b["text"].tolist()
            bounds = items.bounds(ns, b["sketch"].tolist())
            scored: dict[int, np.ndarray] = {}
            for i in np.flatnonzero((bounds >= least).any(axis=0)):
                column, heap = bounds[:, i], heaps[i]
                reach = np.flatnonzero(column >= least[i])
                for d in reach[np.argsort(-column[reach], kind="stable")].tolist():
                    if column[d] < least[i]:
                        break
                    if d not in scored:
                        scored[d] = items.score(int(ns[d]), texts[d])
                    score = int(scored[d][i])
                    if score < least[i]:
                        continue
                    (heapq.heappush if len(heap) < top else heapq.heappushpop)(heap, (score, known[d], -ids[d]))
                    if len(heap) == top:
                        least[i] = max(least[i], heap[0][0])
        found = [(i, -d, k, s) for i, heap in enumerate(heaps) for s, k, d in heap]
        yield pd.DataFrame(found, columns=["item", "doc_id", "known", "score"])

    return index.mapInPandas(run, "item long, doc_id long, known boolean, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    seeds: int = SEEDS,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item."""
    spark = docs.sparkSession
    index = cut_lineage(index_documents(docs, id_col, text_col))
    n_docs, all_terms = index.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_blocks = math.ceil(size / item_bytes)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for k in range(n_blocks if n_docs else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").collect()
        rows = [r for r in rows if terms_of(r["text"])]
        if not rows:
            continue
        block = Items([r["text"] for r in rows])
        block.weigh(n_docs, all_terms, _document_frequencies(index, block.terms))
        shared = spark.sparkContext.broadcast(block)
        by_score = [F.desc("score"), F.asc("doc_id")]
        first = top_k_per_group(_highest_bounds(index, shared, seeds), ["item"], by_score, seeds, ["doc_id"])
        seeded = F.broadcast(spark.createDataFrame([(r["doc_id"],) for r in first.select("doc_id").distinct().collect()], "doc_id long"))
        scores = top_k_per_group(_exact(index.join(seeded, "doc_id", "left_semi"), shared), ["item"], by_score, top, ["doc_id"])
        thresholds = {r["item"]: r["t"] for r in scores.groupBy("item").agg(F.min("score").alias("t"), F.count("*").alias("n")).where(F.col("n") == top).collect()}
        by_rank = [F.desc("score"), F.desc("known"), F.asc("doc_id")]
        best = top_k_per_group(_rescored(index, shared, thresholds, top), ["item"], by_rank, top, ["doc_id"])
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {kind}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "score"))
    return out


def lexical_search_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark)


LEXICAL_SEARCH_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
),
n AS (SELECT doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, s),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
),
qt AS (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL),
scored AS (
  SELECT item_id, tf.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN n ON n.doc_id = tf.doc_id, s
  GROUP BY ALL
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
