"""Language identification: prediction by partial matching over bytes.

Every language has a context tree of order three: how often each byte followed
each context of three, two, one and no bytes, counted by Spark over all
learning rows (a text is read as if three zero bytes stood before it).  With
the statistics frozen, a byte ``s`` after context ``x`` costs
``-log2(c(x,s) / (n(x) + q(x)))`` bits where it was seen (``n`` occurrences of
the context, ``q`` different bytes after it), else the escape
``-log2(q(x) / (n(x) + q(x)))`` plus its cost after the next shorter context; a
context never seen costs nothing to leave, and without any context every byte
costs 8 bits.  The language with the shortest exact code for the whole text is
predicted; the score is its posterior probability under equal priors.

Only the statistics reach the driver.  All learning rows are counted, and the
counts of orders zero to two are sums over all nodes.  Of the four-byte nodes,
if there are more than ``max_nodes``, every language keeps the most frequent
ones of its own, up to an equal part of ``max_nodes`` (nodes of about the most
frequent one's count always stay).  The statistics are broadcast, and texts are scored in one pass without a
shuffle, in slices of bounded size.

Edge cases: null or letterless text gives ``und`` with score 0, as does a table
without any learning row; empty and repeated rows are ordinary rows; equal code
lengths go to the language that sorts first; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

UNKNOWN = "und"
MAX_NODES = 1 << 18
_SLICE = 1 << 20


def _grams(data: np.ndarray) -> np.ndarray:
    """Four-byte codes ending at each byte from the fourth on."""
    d = data.astype(np.uint32)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


def _counted(codes: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_codes, where = np.unique(np.concatenate(codes), return_inverse=True)
    return all_codes, np.bincount(where, weights=np.concatenate(weights)).astype(np.int64)


def count_nodes(rows: DataFrame) -> DataFrame:
    """``lang, code, n`` over all rows of ``text, lang``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        fresh: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def fold() -> None:
            for lang, parts in fresh.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                old = held.get(lang, [])
                held[lang] = [_counted([c for c, _ in old] + [codes], [w for _, w in old] + [n])]
            fresh.clear()

        def flush() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                codes, n = parts[0]
                yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})
            held.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                data = b"\0\0\0" + text.encode("utf-8", "surrogatepass")
                for at in range(0, len(data) - 3, _SLICE):
                    fresh.setdefault(lang, []).append(_grams(np.frombuffer(data, np.uint8, min(len(data) - at, _SLICE + 3), at)))
                    waiting += min(len(data) - at - 3, _SLICE)
                    if waiting > 4 * _SLICE:
                        fold()
                        waiting = 0
            if sum(len(p[0][0]) for p in held.values()) > 4 * _SLICE:
                fold()
                yield from flush()
        fold()
        yield from flush()

    counted = rows.mapInPandas(run, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen code lengths of all languages, as lookup tables."""

    def __init__(self, langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray, lower: tuple | None = None):
        """``lower``: language, three-byte code and count of all nodes, if ``code`` holds a part of them."""
        self.key = uuid.uuid4().hex
        self.langs = langs
        size = len(langs)

        def level(lang: np.ndarray, code: np.ndarray, n: np.ndarray, shorter):
            """Costs of the nodes of one order, and of leaving their contexts."""
            nodes, at = np.unique(code, return_inverse=True)
            counts = np.zeros((len(nodes), size))
            np.add.at(counts, (at, lang), n)
            contexts, of = np.unique(nodes >> 8, return_inverse=True)
            total = np.zeros((len(contexts), size))
            kinds = np.zeros((len(contexts), size))
            np.add.at(total, of, counts)
            np.add.at(kinds, of, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(counts / (total + kinds)[of])
            cost = np.where(counts > 0, seen, escape[of] + shorter(nodes))
            return nodes, cost, contexts, escape

        def marginal(bits: int):
            of, whole, count = lower or (lang, code, n)
            return of, whole & ((1 << bits) - 1), count

        # order 0 and 1: dense
        n0, c0, _, e0 = level(*marginal(8), lambda nodes: np.full((len(nodes), size), 8.0))
        zero = e0[0] + np.full((256, size), 8.0)
        zero[n0] = c0
        n1, c1, x1, e1 = level(*marginal(16), lambda nodes: zero[nodes & 255])
        escape1 = np.zeros((256, size))
        escape1[x1] = e1
        every = np.arange(1 << 16)
        one = escape1[every >> 8] + zero[every & 255]
        one[n1] = c1
        self.one = one.astype(np.float32)
        self.n2, c2, x2, e2 = level(*marginal(24), lambda nodes: one[nodes & 0xFFFF])
        escape2 = np.zeros((1 << 16, size))
        escape2[x2] = e2
        self.escape2 = escape2.astype(np.float32)
        # entry 0 of the tables below stands for "not in the tree"
        self.two = np.vstack([np.zeros(size), c2]).astype(np.float32)

        def after_two(nodes: np.ndarray) -> np.ndarray:
            at = np.searchsorted(self.n2, nodes & 0xFFFFFF)
            return c2[at]

        self.n3, c3, x3, e3 = level(lang, code, n, after_two)
        self.three = np.vstack([np.zeros(size), c3]).astype(np.float32)
        escape3 = np.zeros((len(self.n2) + 1, size))
        at = np.searchsorted(self.n2, x3)
        known = (at < len(self.n2)) & (self.n2[np.minimum(at, len(self.n2) - 1)] == x3)
        self.escape3 = escape3.astype(np.float32)
        self.escape3[at[known] + 1] = e3[known]
        # contexts of three bytes that begin a text hold zero bytes and may not be nodes of order two
        self.other = x3[~known]
        self.other_escape = e3[~known].astype(np.float32)

    def prepare(self) -> None:
        """Lookup tables of a worker process."""
        nodes = np.union1d(self.n2, self.other)
        self.of3 = np.zeros(1 << 24, dtype=np.int32)
        self.of3[nodes] = np.arange(1, len(nodes) + 1)
        two = np.zeros((len(nodes) + 1, len(self.langs)), np.float32)
        escape = np.zeros_like(two)
        two[self.of3[self.n2]] = self.two[1:]
        escape[self.of3[self.n2]] = self.escape3[1:]
        escape[self.of3[self.other]] = self.other_escape
        self.has2 = np.zeros(len(nodes) + 1, dtype=bool)
        self.has2[self.of3[self.n2]] = True
        self.cost2, self.leave3 = two, escape
        self.of4 = np.zeros((len(nodes) + 1) << 8, dtype=np.int32)
        self.of4[(self.of3[self.n3 >> 8].astype(np.int64) << 8) | (self.n3 & 255)] = np.arange(1, len(self.n3) + 1)

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of each byte from the fourth on, per language."""
        d = data.astype(np.int32)
        third = self.of3[(d[:-2] << 16) | (d[1:-1] << 8) | d[2:]]
        before, now = third[:-1], third[1:]
        node = self.of4[(before.astype(np.int64) << 8) | d[3:]]
        cost = self.three[node]
        miss = np.flatnonzero(node == 0)
        if len(miss):
            t, b = now[miss], d[3:][miss]
            p, pp = d[2:-1][miss], d[1:-2][miss]
            rest = np.where(self.has2[t][:, None], self.cost2[t], self.escape2[(pp << 8) | p] + self.one[(p << 8) | b])
            cost[miss] = self.leave3[before[miss]] + rest
        return cost

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text, per language."""
        out = np.zeros((len(texts), len(self.langs)))
        step = max(1 << 12, (_SLICE << 2) // max(4, len(self.langs)))
        group: list[int] = []
        held: list[bytes] = []
        size = 0

        def score() -> None:
            data = np.frombuffer(b"".join(held), np.uint8)
            ends = np.cumsum([len(h) for h in held])
            starts = ends - [len(h) for h in held]
            cost = self.bits(data)  # entry i is byte i + 3
            # the three bytes before each text are not part of it
            sums = np.add.reduceat(np.vstack([cost.astype(np.float64), np.zeros((1, out.shape[1]))]), np.stack([starts, ends - 3], 1).ravel())[::2]
            np.add.at(out, group, np.where((ends - 3 > starts)[:, None], sums, 0.0))

        for i, text in enumerate(texts):
            raw = b"\0\0\0" + text.encode("utf-8", "surrogatepass")
            for at in range(0, len(raw) - 3, step):
                part = raw[at : at + step + 3]
                held.append(part)
                group.append(i)
                size += len(part)
                if size > step:
                    score()
                    held.clear(), group.clear()
                    size = 0
        if held:
            score()
        return out


def fit(rows: DataFrame, max_nodes: int = MAX_NODES) -> ContextTrees | None:
    """Trees from all rows of ``text, lang`` (both not null)."""
    nodes = cut_lineage(count_nodes(rows))
    totals = {r["lang"]: r["n"] for r in nodes.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    langs = sorted(totals)
    share = F.col("n") / F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(float(totals[k])))]), F.col("lang"))
    at = {k: i for i, k in enumerate(langs)}

    def arrays(kept: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = kept.toPandas()
        return kept["lang"].map(at).to_numpy(), kept["code"].to_numpy(np.int64), kept["n"].to_numpy(np.float64)

    # the most frequent nodes of each language: whole steps of an eighth of a bit of their share, as far as its part goes
    stepped = nodes.withColumn("step", F.floor(F.log2(share) * 8))
    sizes = stepped.groupBy("lang", "step").count().orderBy("lang", F.desc("step")).collect()
    if sum(r["count"] for r in sizes) <= max_nodes:
        return ContextTrees(langs, *arrays(nodes.select("lang", "code", "n")))
    held: dict[str, int] = {}
    last: dict[str, int] = {}
    for r in sizes:
        held[r["lang"]] = held.get(r["lang"], 0) + r["count"]
        if r["lang"] not in last or held[r["lang"]] <= max_nodes // len(langs):
            last[r["lang"]] = r["step"]
    least = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(last[k]))]), F.col("lang"))
    lower = nodes.groupBy("lang", F.col("code").bitwiseAND(0xFFFFFF).alias("code")).agg(F.sum("n").alias("n"))
    return ContextTrees(langs, *arrays(stepped.where(F.col("step") >= least).select("lang", "code", "n")), arrays(lower))


_READY: dict[str, ContextTrees] = {}


def predict(docs: DataFrame, trees: ContextTrees | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``bits_per_byte``
    (of the predicted language; null where there is none)."""
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    if trees is None:
        none = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")}
        return docs.select(*keep).withColumns(none)
    text_at = text_col if text_col in keep else "__text"
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        if model.key not in _READY:
            model.prepare()
            _READY.clear()
            _READY[model.key] = model
        model = _READY[model.key]
        langs = np.array(model.langs, dtype=object)
        for b in batches:
            out = b[keep].copy()
            ok = b["__lettered"].to_numpy(dtype=bool)
            texts = [t if u else "" for t, u in zip(b[text_at], ok)]
            bits = model.lengths(texts)
            best = bits.argmin(axis=1) if len(out) else np.zeros(0, dtype=int)
            least = bits[np.arange(len(out)), best]
            odds = np.exp2(-np.minimum(bits - least[:, None], 1000.0)).sum(axis=1)
            n = np.array([max(1, len(t.encode("utf-8", "surrogatepass"))) if u else 1 for t, u in zip(texts, ok)], dtype=float)
            out["lang_pred"] = np.where(ok, langs[best], UNKNOWN) if len(out) else []
            out["score"] = np.where(ok, 1.0 / np.maximum(odds, 1.0), 0.0)
            out["bits_per_byte"] = np.where(ok, least / n, np.nan)
            yield out

    rows = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias(text_at)]), lettered.alias("__lettered"))
    return rows.mapInPandas(run, f"{fields}, lang_pred string, score double, bits_per_byte double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, keep: list[str], max_nodes: int = MAX_NODES) -> DataFrame:
    """Learn from the rows that are not held out and have text and language,
    then predict every row."""
    rows = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    return predict(docs, fit(rows, max_nodes), keep)


def language_id_query(docs: DataFrame) -> DataFrame:
    out = identify(docs, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
