"""Near duplicates: order min-hash over five-word shingles.

A text is read as its sequence of five-word shingles (words ``\\w+``, lower
case; a text of fewer words is one shingle), each labelled with its occurrence
number, so that no labelled shingle repeats in a text.  A sketch entry draws
the labelled shingles with the smallest hashes (six, or three for texts of few
shingles; texts in between have entries of both kinds) and keeps them in their
order in the text; texts that agree in an entry therefore share shingles *and*
their order, which makes the entry sensitive to edit similarity.  Texts that
agree in one entry are candidates; at similarity 0.8 all 32 entries of six
differ with probability 6e-5, all 16 of three with 1e-5.

Candidates are verified by a banded alignment of the two shingle sequences:
``L`` shingles aligned in order give the similarity ``L / (a + b - L)``, and a
link is a similarity of ``threshold`` or more.  No aligned pair of positions can
then lie further than ``(a + b) (1 - t) / (1 + t)`` off the diagonal, which is
the band.  Groups are the connected components of the links.

Scale.  Texts with equal words are one class, and only classes are compared.
In a bucket every class is first compared with a few leaders, which joins a
group of thousands of copies with few comparisons each; then the groups still
apart in some bucket are compared with each other, class by class: block
against block, where a product of incidence matrices counts the shared
shingles of all pairs and only pairs that share enough are aligned.  So no link that joins two groups is missed among the
candidates, and no group is written out in pairs.  Buckets are
spread by join keys, never collected.  Every step is a written table.

Edge cases: null texts and texts without a word are nobody's copy (a class of
their own); a row without an id gets null class and group; repeated rows are
copies; further columns are ignored by :func:`near_duplicates` and kept by
:func:`keep_one`; tables may be empty.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release

SHINGLE = 5
THRESHOLD = 0.8
#: (minima, entries, fewest shingles, shingles it is not used from); the ranges overlap by the factor 0.8
TIERS = ((3, 16, 1, 30), (6, 32, 24, None))
LEADER_ROUNDS = 2
BLOCK = 256

_WORD = re.compile(r"\w+")
_KNOWN: dict[str, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public domain constants of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    try:
        return np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(_KNOWN) > 500_000:
            _KNOWN.clear()
        for w in set(words):
            if w not in _KNOWN:
                _KNOWN[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles, in text order."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = word_hashes(words)
    k = min(size, len(w))
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    order = np.argsort(h, kind="stable")
    run = h[order]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    label = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
    occurrence = np.empty(len(h), dtype=np.uint64)
    occurrence[order] = label
    return np.where(occurrence > 0, _mix(h + occurrence * np.uint64(0x9E3779B97F4A7C15)), h)


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = _mix(np.arange(1, 65, dtype=np.uint64) * _GOLDEN)
_ODD = _mix(_SEEDS) | np.uint64(1)


def sketch(s: np.ndarray) -> list[int]:
    """One hash per entry: the labelled shingles with the smallest hashes, in
    text order."""
    out: list[int] = []
    step = max(1, (1 << 22) // max(1, len(s)))
    for tier, (minima, entries, fewest, until) in enumerate(TIERS):
        if len(s) < fewest or (until is not None and len(s) >= until):
            continue
        m = min(minima, len(s))
        for e in range(0, entries, step):
            these = slice(e, min(entries, e + step))
            h = (s[None, :] ^ _SEEDS[these, None]) * _ODD[these, None]
            at = np.sort(np.argpartition(h, m - 1, axis=1)[:, :m], axis=1) if m < len(s) else np.tile(np.arange(m), (len(h), 1))
            drawn = s[at]
            key = _SEEDS[these] + np.uint64(tier)
            for i in range(m):
                key = _mix(key * _GOLDEN + drawn[:, i])
            out += key.astype(np.int64).tolist()
    return out


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity by the banded alignment of two labelled sequences; 0.0 as
    soon as it is below the threshold for certain."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    need = threshold * (n + m) / (1 + threshold)
    lo = 0
    stop = min(n, m)
    differ = np.flatnonzero(a[:stop] != b[:stop])
    lo = int(differ[0]) if len(differ) else stop
    differ = np.flatnonzero(a[n - stop + lo :][::-1] != b[m - stop + lo :][::-1]) if lo < stop else np.zeros(0, int)
    hi = (int(differ[0]) if len(differ) else stop - lo) if lo < stop else 0
    x, y = a[lo : n - hi], b[lo : m - hi]
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    best = lo + hi
    if best + len(common) < need - 1e-9:
        return 0.0
    if len(common):
        band = (n + m) * (1 - threshold) / (1 + threshold) + 1e-9
        inside = np.abs(i - j) <= band
        i, j = i[inside], j[inside]
        tails: list[int] = []  # longest increasing run of positions: labels are unique, so this is the alignment
        for p in j[np.argsort(i)].tolist():
            k = bisect_left(tails, p)
            if k == len(tails):
                tails.append(p)
            else:
                tails[k] = p
        best += len(tails)
    return best / (n + m - best)


def text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _class(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, cls, n, entries`` of every row; ``cls`` is null without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["id"], b["text"]):
                words = text_words(text)
                s = shingles(words)
                rows.append((doc, _class(words) if words else None, len(s), sketch(s) if words else []))
            yield pd.DataFrame(rows, columns=["id", "cls", "n", "entries"]).astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "id long, cls binary, n int, entries array<long>")


def _sequences(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``cls, seq`` (shingle hashes as bytes) of the classes in ``wanted``
    (``cls, rep``: a document that holds it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cls, text in zip(b["cls"], b["text"]):
                words = text_words(text)
                if _class(words) == bytes(cls):  # an id may stand for several texts
                    rows.append((bytes(cls), shingles(words).tobytes()))
            yield pd.DataFrame(rows, columns=["cls", "seq"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    found = texts.join(wanted, "rep").select("cls", "text").mapInPandas(run, "cls binary, seq binary")
    return found.groupBy("cls").agg(F.first("seq").alias("seq"))


def _verified(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """The links among ``pairs`` (``a, b``), with their similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sim = [
                alignment(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(b["sa"], b["sb"])
            ]
            out = b[["a", "b"]].assign(similarity=sim)
            yield out[out["similarity"] >= threshold - 1e-12]

    sa = sequences.select(F.col("cls").alias("a"), F.col("seq").alias("sa"))
    sb = sequences.select(F.col("cls").alias("b"), F.col("seq").alias("sb"))
    return pairs.join(sa, "a").join(sb, "b").mapInPandas(run, "a binary, b binary, similarity double")


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: connected
    components by large-star and small-star steps, each round a written table.
    ``root`` is the smallest node."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    flat = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = cut_lineage(flat)
    before = mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut_lineage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(edges)
        edges, after = small, mark(small)
        if after == before:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    leader_rounds: int = LEADER_ROUNDS,
) -> DataFrame:
    """``id_col, class_id, group_id`` of every row: the smallest id with the
    same words, and the smallest id in the connected group."""
    sketched = cut_lineage(sketch_documents(docs, id_col, text_col))
    worded = sketched.where(F.col("cls").isNotNull())
    classes = (
        worded.where(F.col("id").isNotNull())
        .groupBy("cls")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("entries").alias("entries"))
    )
    entries = classes.select("cls", "rep", "n", F.explode("entries").alias("h"))
    # counted alone: most buckets hold one class, and then only their hash and count are shuffled
    shared = entries.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = cut_lineage(entries.join(shared, "h"))
    sequences = cut_lineage(_sequences(docs, members.select("cls", "rep").distinct(), id_col, text_col))

    # the leaders of a bucket: the classes whose hashes with the leader's number are smallest
    leads = [
        F.min(F.struct(F.xxhash64("cls", F.lit(r)).alias("x"), F.col("cls").alias("leader"), F.col("n").alias("ln")))
        for r in range(leader_rounds)
    ]
    leaders = members.groupBy("h").agg(F.array(*leads).alias("leaders"))
    pairs = (
        members.join(leaders, "h")
        .select("cls", "n", F.explode("leaders").alias("l"))
        .select("cls", "n", "l.leader", "l.ln")
        .where((F.col("cls") != F.col("leader")) & (F.least("n", "ln") >= threshold * F.greatest("n", "ln")))
        .select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
        .distinct()
    )
    links = cut_lineage(_verified(pairs, sequences, threshold))
    first = components(links)
    across = cut_lineage(_across(_apart(members, first), sequences, threshold))
    second = components(across)
    grouped = (
        worded.groupBy("cls")
        .agg(F.min("id").alias("class_id"))
        .join(first.select(F.col("node").alias("cls"), F.col("root").alias("r1")), "cls", "left")
        .withColumn("r1", F.coalesce("r1", "cls"))
        .join(second.select(F.col("node").alias("r1"), F.col("root").alias("r2")), "r1", "left")
        .select("cls", "class_id", F.coalesce("r2", "r1").alias("root"))
    )
    group_ids = grouped.groupBy("root").agg(F.min("class_id").alias("group_id"))
    out = sketched.select("id", "cls").join(grouped.join(group_ids, "root").select("cls", "class_id", "group_id"), "cls", "left")
    alone = F.col("cls").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNull(), None).when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("id").isNull(), None).when(alone, F.col("id")).otherwise(F.col("group_id")).alias("group_id"),
    )


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Number of shingles each left sequence shares with each right one."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(both), columns):
        part = both[at : at + columns]
        sides = []
        for seqs in (left, right):
            m = np.zeros((len(seqs), len(part)), dtype=np.float32)
            for i, s in enumerate(seqs):
                k = np.searchsorted(part, s)
                k = k[(k < len(part)) & (part[np.minimum(k, len(part) - 1)] == s)]
                m[i, k] = 1.0
            sides.append(m)
        counts += sides[0] @ sides[1].T
    return counts


def block_links(left: list[tuple], right: list[tuple], threshold: float) -> Iterator[tuple[bytes, bytes, float]]:
    """Links between the groups of two blocks of ``(cls, root, seq)``, each
    by two classes of them; a pair whose groups a link of this call has joined
    already is skipped."""
    joined: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while x in joined:
            x = joined[x]
        return x

    counts = _shared_counts([s for _, _, s in left], [s for _, _, s in right])
    a = np.array([len(s) for _, _, s in left])
    b = np.array([len(s) for _, _, s in right])
    need = threshold * (a[:, None] + b[None, :]) / (1 + threshold)
    for i, j in zip(*np.nonzero(counts >= need - 1e-6)):
        (_, rx, sx), (_, ry, sy) = left[i], right[j]
        if rx != ry and (p := root(rx)) != (q := root(ry)) and (sim := alignment(sx, sy, threshold)) >= threshold - 1e-12:
            joined[max(p, q)] = min(p, q)
            yield min(rx, ry), max(rx, ry), sim


def _across(apart: DataFrame, sequences: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between the groups (by their roots) that share a bucket."""
    sizes = apart.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cells = cut_lineage(
        apart.join(sizes, "h")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .join(sequences, "cls")
        .groupBy("h", "blocks", "block")
        .agg(F.collect_list(F.struct("cls", "root", "seq")).alias("members"))
    )
    left = cells.select("h", F.col("members").alias("m1"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    right = cells.select("h", F.col("block").alias("other"), F.col("members").alias("m2"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for m1, m2 in zip(b["m1"], b["m2"]):
                sides = [[(bytes(r["cls"]), bytes(r["root"]), np.frombuffer(r["seq"], np.uint64)) for r in m] for m in (m1, m2)]
                rows += block_links(*sides, threshold)
            yield pd.DataFrame(rows, columns=["a", "b", "similarity"])

    return left.join(right, ["h", "other"]).select("m1", "m2").mapInPandas(run, "a binary, b binary, similarity double")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their group so far, in buckets that hold several groups.
    In a bucket of two classes the leader has met the other one already."""
    known = (
        members.where("k > 2")
        .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .select("h", "cls", F.coalesce("root", "cls").alias("root"))
    )
    several = known.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h")
    return cut_lineage(known.join(several, "h"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the smallest id of every group, with all its columns (of
    rows that repeat that id, one); texts without words and rows without an id
    stay."""
    groups = cut_lineage(near_duplicates(docs, id_col, text_col, **options))
    gone = groups.where(F.col(id_col) != F.col("group_id")).select(F.col(id_col).alias("__gone")).distinct()
    rest = docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    # rows that repeat an id with words: one of them (ids are unique in most tables, so this rarely runs)
    wordy = F.coalesce(F.col(text_col).rlike(r"(?U)\w"), F.lit(False))
    twice = cut_lineage(
        rest.where(wordy & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__twice")).count().where("count > 1").select("__twice")
    )
    if not twice.limit(1).count():
        return rest
    again = F.col(id_col) == F.col("__twice")
    repeated = rest.join(twice, again, "left_semi")
    return (
        rest.join(twice, again, "left_anti")
        .unionByName(repeated.where(~wordy))
        .unionByName(repeated.where(wordy).dropDuplicates([id_col]))
    )


def near_duplicates_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
