"""Personal data: base patterns and information-theoretic sanitisation.

The base patterns (email, ip, card, phone) give the protected entities.  A
term (a word of three letters or more near a mention) discloses an entity
``e`` as far as the corpus says so: with documents as events,
``PMI(e; t) = log2 p(e, t) / (p(e) p(t))`` bits of the entity's information
content ``IC(e) = -log2 p(e)`` are revealed by the term.  Terms with
``PMI >= alpha * IC`` are marked and generalised, by the query in every document
that holds one (``everywhere``): the term discloses its entity where the entity
is not mentioned, too.  Whole documents are counted,
and equal texts are one document.  Weak evidence is smoothed, not left out:
``p(e | t) = (n(e, t) + EVIDENCE p(e)) / (n(t) + EVIDENCE)``, so an entity seen
once discloses through words seen about as rarely, in a corpus large enough.

Scale: digests tell copies apart, and texts move once, to the terms marked in
them.  Document frequencies are summed per batch; only terms of texts that may
be copies (a bitmap of fixed size lets some others through) are kept apart by
digest.  Terms too frequent for every entity of a document go before pairs
are made.  Frequent terms are joined by broadcast (at most ``HOT_SHARE`` times the
terms of an average document), the others by term.  Nothing but
the bitmaps is collected.

Edge cases: null text is empty; repeated rows are
rows of their own and one document of the counts; an entity of every document
has no information to disclose; ties in start
go by kind as listed below; empty tables give empty tables; further columns
are ignored by the query.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

KINDS = ["email", "ip", "card", "phone", "term"]
ALPHA = 0.9
#: documents that independence is worth in an estimate
EVIDENCE = 0.5
#: a term of more than one in so many documents is frequent
HOT_SHARE = 1_000
#: bits of the bitmaps of digests and terms
BITS = 1 << 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its first digit only: it fails alike from the others
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` (a long run of address
    characters without one costs nothing)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _entity(text: str, span: tuple[int, int, int]) -> str:
    a, k, b = span
    value = text[a:b].lower() if k < 2 else "".join(_DIGITS.findall(text[a:b]))
    return f"{KINDS[k]}:{value}"


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """Distinct terms outside the base spans."""
    if not spans:
        return {t.lower() for t in set(_TERM.findall(text))}
    return {text[a:b].lower() for a, b in term_places(text, spans)}


def term_places(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Terms that overlap no base span (in order of their start)."""
    at, reach = 0, 0  # spans that start before the term's end, and how far they reach
    for m in _TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            yield m.span()


def bitmap(keys: DataFrame, col: str) -> np.ndarray:
    """Bits of the keys' checksums, in words of 64."""
    h = F.pmod(F.crc32(col), F.lit(BITS))
    words = keys.select(h.alias("h")).groupBy((F.col("h") / 64).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("word")
    )
    out = np.zeros(BITS // 64, dtype=np.int64)
    for r in words.collect():
        out[r["at"]] = r["word"]
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, key: bytes) -> bool:
    h = zlib.crc32(key) % BITS
    return bool(int(bits[h >> 6]) >> (h & 63) & 1)


def document_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def find_mentions(rows: DataFrame) -> DataFrame:
    """``digest, entities, terms`` of the distinct texts with a mention."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {}
            for digest, text in zip(b["digest"], b["text"]):
                if digest not in out and (spans := base_spans(text)):
                    out[digest] = (digest, sorted({_entity(text, s) for s in spans}), sorted(terms_of(text, spans)))
            yield pd.DataFrame(list(out.values()), columns=["digest", "entities", "terms"])

    found = rows.select("digest", "text").mapInPandas(run, "digest binary, entities array<string>, terms array<string>")
    return found.groupBy("digest").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"))


def term_counts(rows: DataFrame, copies: np.ndarray) -> DataFrame:
    """``term, n_term``: distinct texts that hold the term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            summed, apart = Counter(), {}
            for digest, text in zip(b["digest"], b["text"]):
                if digest not in apart:
                    terms = terms_of(text, base_spans(text))
                    if in_bitmap(copies, digest):
                        apart[digest] = terms
                    else:
                        summed.update(terms)
            out = [(t, n, None) for t, n in summed.items()] + [(t, 1, d) for d, terms in apart.items() for t in terms]
            yield pd.DataFrame(out, columns=["term", "n", "digest"])

    counted = rows.select("digest", "text").mapInPandas(run, "term string, n long, digest binary")
    once = counted.groupBy("term", "digest").agg(F.sum("n").alias("n"))
    n = F.when(F.col("digest").isNull(), F.col("n")).otherwise(1)
    return once.groupBy("term").agg(F.sum(n).alias("n_term"))


def with_counts(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Rows with a term, joined to the counts of their term."""
    frequent = F.col("n_term") * HOT_SHARE > total
    hot = F.broadcast(counts.where(frequent))
    cold = rows.join(F.broadcast(counts.where(frequent).select("term")), "term", "left_anti")
    return rows.join(hot, "term").unionByName(cold.join(counts.where(~frequent), "term"))


def disclosing_terms(found: DataFrame, n_term: DataFrame, total: int, alpha: float = ALPHA) -> DataFrame:
    """``entity, term, n_term, pmi, ic`` of the pairs over the threshold."""
    seen = found.select("digest", F.explode("entities").alias("entity"))
    p = F.col("n_entity") / F.lit(total)
    gate = F.pow(p, F.lit(1 - alpha))
    # a term in more documents than this fails even if every mentioning document holds it
    most = (F.col("n_entity") + EVIDENCE * p) / gate - EVIDENCE + 1e-6
    entities = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") < total)
    seen = cut_lineage(seen.join(entities, "entity").withColumn("most", most))
    limits = seen.groupBy("digest").agg(F.max("most").alias("most"))
    terms = with_counts(found.select("digest", F.explode("terms").alias("term")), n_term, total)
    terms = terms.join(limits, "digest").where(F.col("n_term") <= F.col("most")).drop("most")
    pairs = (
        seen.join(terms, "digest").where(F.col("n_term") <= F.col("most"))
        .groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    )
    smoothed = (F.col("n_both") + EVIDENCE * p) / (F.col("n_term") + EVIDENCE)
    scored = pairs.withColumn("ic", -F.log2(p)).withColumn("pmi", F.log2(smoothed / p))
    return scored.where(F.col("pmi") >= alpha * F.col("ic")).select("entity", "term", "n_term", "pmi", "ic")


def holders(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``digest, term``: the terms of every distinct text that may be wanted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for b in batches:
            out, seen = [], set()
            for digest, text in zip(b["digest"], b["text"]):
                if digest in seen:
                    continue
                seen.add(digest)
                for t in terms_of(text, base_spans(text)):
                    if t not in known:
                        if len(known) >= 1 << 16:
                            known.clear()
                        known[t] = in_bitmap(wanted, t.encode("utf-8", "surrogatepass"))
                    if known[t]:
                        out.append((digest, t))
            yield pd.DataFrame(out, columns=["digest", "term"])

    return rows.select("digest", "text").mapInPandas(run, "digest binary, term string").distinct()


def find_personal_data(docs: DataFrame, alpha: float = ALPHA, everywhere: bool = False) -> DataFrame:
    """``doc_id``, counts, ``base_spans``, ``spans`` (with terms), and the
    sanitised text of documents with a span (else null).  ``everywhere``: terms
    are marked in all documents, not only in those that mention their entity."""
    rows = document_rows(docs)
    sizes = cut_lineage(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.count()
    found = cut_lineage(find_mentions(rows))
    n_term = cut_lineage(term_counts(rows, bitmap(sizes.where("n > 1"), "digest")))
    flagged = cut_lineage(disclosing_terms(found, n_term, total, alpha))
    if everywhere:
        terms = flagged.groupBy("term").agg(F.max("n_term").alias("n_term"))
        marked = with_counts(holders(rows, bitmap(terms, "term")), terms, total)
    else:
        marked = (
            found.select("digest", F.explode("entities").alias("entity"))
            .join(flagged.select("entity", "term"), "entity")
            .join(found.select("digest", "terms"), "digest")
            .where(F.array_contains("terms", F.col("term")))
        )
    marked = cut_lineage(marked.groupBy("digest").agg(F.collect_set("term").alias("marks")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, marks in zip(b["doc_id"], b["text"], b["marks"]):
                base = spans = base_spans(text)
                if marks is not None and len(marks):
                    wanted = set(marks)
                    spans = sorted(spans + [(a, 4, z) for a, z in term_places(text, base) if text[a:z].lower() in wanted])
                n = [sum(1 for s in base if s[1] == k) for k in range(4)]
                out.append((doc, *n, joined(base), joined(spans), mask(text, spans) if spans else None))
            names = "doc_id n_email n_ip n_card n_phone base_spans spans sanitised".split()
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, sanitised string"
    return rows.join(marked, "digest", "left").select("doc_id", "text", "marks").mapInPandas(run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span generalised to its kind (spans that overlap
    become one, named after the first)."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def privacy_query(docs: DataFrame) -> DataFrame:
    out = find_personal_data(docs.select("doc_id", "text"), everywhere=True)
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans",
    )
