"""Cross-tokenizer alignment: counts of linked id pairs by minimal perfect hashing.

Every text is encoded by a byte-level vocabulary (A) and a piece vocabulary
(B).  Both cut the bytes of ``" " + text``; offsets where a token of each ends
cut them into groups, and an A and a B token are linked where their byte
ranges overlap.

1. A first pass aligns the documents; a task writes each linked pair it met
   with how many of its documents hold it.
2. The distinct pairs are dealt to buckets by their A id.  A bucket becomes a
   minimal perfect hash: per level a bit array where a key's slot is set if no
   other key of the level has it; keys that clash go to the next level, and the
   rank of its bit numbers a key.
3. Every task adds written counts into one dense vector indexed by the hash;
   the vectors are summed up a tree.
4. A second pass re-aligns the documents and looks the counts up.  A lookup
   compares the key stored at its index, so an unknown pair is an error and
   never another pair's count.

Keys, counts and hashes of at most ``pairs_per_block`` pairs are broadcast at a
time; more pairs take several blocks, each with its own pass, and a document's
sums are added over the blocks.  All pairs of an A id lie in one block, so its
highest count is known there.  Nothing is left out.

Neither vocabulary merges over the place between a visible character and a
space, so texts are encoded in the chunks between such places, and a task
remembers the alignments of its chunks in a bounded memory.

Edge cases: texts that are null, empty, or not given back byte by byte by both
vocabularies have no tokens: zeros and an empty digest column.  Rows with
equal ids are documents of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release, tree_sum
from .pieces import tokenizer_path

PAIRS_PER_BLOCK = 1 << 22
PAIRS_PER_BUCKET = 1 << 14
#: bits of a level for each of its keys
SLACK = 1.5
#: characters of texts looked up together, and of chunks aligned together
_TEXT_CHARS = 1 << 20
_CHARS = 1 << 18
#: chunks, and characters of chunks, from which a task's memory starts anew
_KNOWN = 600_000
_KNOWN_CHARS = 1 << 24
#: pairs a task holds before it makes them distinct
_HELD = 1 << 21


#: what is known of a chunk, in this order; ``LOST`` is 1 if a vocabulary doesn't give it back
FACTS = LOST, N_A, N_B, N_GROUPS, N_LINKS = range(5)

# --- one text ----------------------------------------------------------------

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def chunks_of(text: str) -> list[str]:
    """``" " + text`` cut wherever a space follows a visible character; a
    chunk is written without the space it starts with."""
    if _SPACE_AFTER_SPACE.search(" " + text):
        return [c[1:] for c in _CUT.split(" " + text)]
    return text.split(" ")


def _open(chunk: str) -> bool:
    """Whether a chunk doesn't end in a visible character."""
    return not chunk or chunk[-1].isspace()


class Aligner:
    """Alignments of chunks by the two vocabularies; a link is ``a << 16 | b``."""

    def __init__(self, ranks: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.a_bytes = [b""] * (max(table.values()) + 1)
        for data, i in table.items():
            self.a_bytes[i] = data
        self.a_file = re.sub(r"\.tiktoken$", ".json", ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id("▁")
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        crossing = [p for p in map(self.b.id_to_piece, range(len(self.b_bytes))) if "▁" in p.lstrip("▁")]
        if crossing:
            raise ValueError(f"pieces may hold a space only at their start: {crossing[:3]}")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        plain = list(map(str, range(1 << 16)))
        self.words = np.array([[w + sign for w in plain] for sign in ",|;"], object)

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def _a_ids(self, chunks: list[str]) -> list[list[int]]:
        """Chunks between one that ends in a visible character and the next
        such are encoded as one text, as no token runs over their starts."""
        try:
            opened = [c for c in chunks if _open(c)]
            if not opened:
                return [self.a.encode_ordinary(" " + " ".join(chunks))]
            out, run = [], []
            for c in chunks:
                run.append(c)
                if _open(c):
                    out.append(self.a.encode_ordinary(" " + " ".join(run)))
                    run = []
            return [*out, self.a.encode_ordinary(" " + " ".join(run))] if run else out
        except ValueError:  # its regex engine gives up on white space of some 10^5 characters in a row
            if len(chunks) > 1:
                return [self._a_ids([c])[0] for c in chunks]
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self.a_file)
            library.encode_special_tokens = True
            return [library.encode(" " + chunks[0], add_special_tokens=False).ids]

    def align(self, chunks: list[str], with_groups: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All chunks at once, as one run of bytes: the ``FACTS`` of each chunk
        as columns, the links of all, and the text of each chunk's groups.  Of
        chunks that aren't given back, each is found by halving."""
        each_a = self._a_ids(chunks)
        each_b = [b if c else [self.space] for b, c in zip(self.b.encode(chunks, num_threads=1), chunks)]
        data = [b" " + c.encode() for c in chunks]
        whole = b"".join(data)
        ids = []
        for each, table in ((each_a, self.a_bytes), (each_b, self.b_bytes)):
            ids.append(list(chain.from_iterable(each)))
            if b"".join(map(table.__getitem__, ids[-1])) != whole:
                return self._halves(chunks, with_groups)
        a, b = (np.array(x, np.uint32) for x in ids)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        chunk_ends = np.cumsum(list(map(len, data)))
        end_of_a, end_of_b = (np.zeros(len(whole) + 1, bool) for _ in range(2))
        end_of_a[a_ends] = end_of_b[b_ends] = True
        if not (end_of_a[chunk_ends] & end_of_b[chunk_ends]).all():
            return self._halves(chunks, with_groups)
        ends = np.flatnonzero(end_of_a | end_of_b)
        links = (a[np.searchsorted(a_ends, ends)] << np.uint32(16)) | b[np.searchsorted(b_ends, ends)]
        both = np.flatnonzero(end_of_a & end_of_b)
        facts = np.zeros((len(FACTS), len(chunks)), np.int64)
        for i, e in ((N_A, a_ends), (N_B, b_ends), (N_GROUPS, both), (N_LINKS, ends)):
            facts[i] = np.diff(np.searchsorted(e, chunk_ends, side="right"), prepend=0)
        return facts, links, self._groups(a, b, a_ends, b_ends, end_of_a, end_of_b, both, facts) if with_groups else []

    def _halves(self, chunks: list[str], with_groups: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
        if len(chunks) == 1:
            facts = np.zeros((len(FACTS), 1), np.int64)
            facts[LOST] = 1
            return facts, np.zeros(0, np.uint32), [""] if with_groups else []
        middle = len(chunks) // 2
        (f, x, s), (g, y, t) = (self.align(part, with_groups) for part in (chunks[:middle], chunks[middle:]))
        return np.concatenate([f, g], axis=1), np.concatenate([x, y]), s + t

    def _groups(self, a, b, a_ends, b_ends, end_of_a, end_of_b, both, facts) -> list[str]:
        """Each chunk's groups as text, ``;`` after every group: every token is
        a word with the sign that follows it, put in the order of the groups."""
        group_a, group_b = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        words = np.empty(len(a) + len(b), object)
        words[place_a] = self.words[np.where(end_of_b[a_ends], 1, 0), a]
        words[place_b] = self.words[np.where(end_of_a[b_ends], 2, 0), b]
        words = words.tolist()
        cuts = [0, *np.cumsum(facts[N_A] + facts[N_B]).tolist()]
        return ["".join(words[i:j]) for i, j in zip(cuts, cuts[1:])]

    def documents(self, texts: list[str | None], with_groups: bool) -> Iterator[np.ndarray]:
        """The ``FACTS`` of each text's chunks, a row a chunk."""
        memory = Memory(self, with_groups)
        for at in memory.documents(texts):
            yield memory.facts[:, at].T


class _Numbers(dict):
    """Numbers chunks in the order in which they are first met."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class Memory:
    """The alignments of the chunks that a task has met, in flat arrays by
    number.  It starts anew when full; only speed depends on that.  ``derive``
    gives further rows of numbers for new chunks from their facts and links."""

    def __init__(self, own: Aligner, with_groups: bool, derive=None):
        self.own, self.with_groups, self.derive = own, with_groups, derive
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.chars = _Numbers(), 0
        self.facts = np.zeros((len(FACTS), 0), np.int64)
        self.starts = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.uint32)
        self.derived: np.ndarray | None = None
        self.groups: list[str] = []

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        facts, links, derived, i = [self.facts], [self.links], [] if self.derived is None else [self.derived], 0
        while i < len(new):
            j, size = i, 0
            while j < len(new) and (j == i or size + len(new[j]) <= _CHARS):
                size += len(new[j])
                j += 1
            own_facts, own_links, groups = self.own.align(new[i:j], self.with_groups)
            if self.derive:
                derived.append(self.derive(own_facts, own_links))
            facts.append(own_facts)
            links.append(own_links)
            self.groups += groups
            self.chars += size
            i = j
        if new:
            self.facts, self.links = np.concatenate(facts, axis=1), np.concatenate(links)
            self.starts = np.cumsum(self.facts[N_LINKS]) - self.facts[N_LINKS]
            if self.derive:
                self.derived = np.concatenate(derived, axis=1)

    def batches(self, texts: list[str | None]) -> Iterator[list[np.ndarray]]:
        """The numbers of each text's chunks, of several texts at a time;
        they hold until the next step."""
        i = 0
        while i < len(texts):
            if len(self.numbers) > _KNOWN or self.chars > _KNOWN_CHARS:
                self._clear()
            out, size = [], 0
            while i < len(texts) and size < _TEXT_CHARS:
                chunks = chunks_of(texts[i]) if texts[i] else []
                out.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks)))
                size += len(texts[i] or "")
                i += 1
            self._learn()
            yield out

    def documents(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for batch in self.batches(texts):
            yield from batch

    def pair_counts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of some texts at a time, with how many hold each."""
        for batch in self.batches(texts):
            kept = [at for at in batch if not self.facts[LOST, at].any()]
            at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            sizes = self.facts[N_LINKS, at]
            text = np.repeat(np.repeat(np.arange(len(kept)), np.array(list(map(len, kept)), np.int64)), sizes)
            place = np.arange(len(text)) + np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
            held = np.unique((text.astype(np.uint64) << np.uint64(32)) | self.links[place].astype(np.uint64))
            yield np.unique((held & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(ranks: str, pieces: str) -> Aligner:
    """One per worker process and pair of files."""
    if (ranks, pieces) not in _ALIGNERS:
        _ALIGNERS[ranks, pieces] = Aligner(ranks, pieces)
    return _ALIGNERS[ranks, pieces]


# --- minimal perfect hashing ---------------------------------------------------


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 well mixed bits of each key; different keys stay different."""
    x = keys.astype(np.uint64) + np.uint64(((level + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits, and the keys in the order of their
    numbers, for distinct keys."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(8, math.ceil(SLACK * len(left)))
        at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    bits = np.concatenate(bits) if bits else np.zeros(0, bool)
    ordered = np.zeros_like(keys)
    table = PairTable(0, [(0, len(keys), sizes, np.packbits(bits).tobytes(), b"")])
    ordered[table._numbers(keys)] = keys
    return sizes, bits, ordered


class PairTable:
    """The hashes of some buckets, with their keys and, later, counts."""

    def __init__(self, n_buckets: int, rows: list[tuple[int, int, list[int], bytes, bytes]]):
        """Rows of bucket, number of keys, sizes of levels, packed bits, keys."""
        self.n_buckets, self.rows = n_buckets, rows
        self._ready = False

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("n_buckets", "rows", "counts")} | {"_ready": False}

    def _prepare(self) -> None:
        if self._ready:
            return
        levels = max([len(r[2]) for r in self.rows], default=0)
        self.at = np.full(max(1, self.n_buckets), -1)
        self.sizes = np.zeros((levels, len(self.rows)), np.int64)
        self.starts = np.zeros((levels, len(self.rows)), np.int64)
        bits, start = [], 0
        for i, (bucket, _, sizes, packed, _) in enumerate(self.rows):
            self.at[bucket] = i
            total = sum(sizes)
            bits.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=total).astype(bool))
            self.sizes[: len(sizes), i] = sizes
            self.starts[: len(sizes), i] = start + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if sizes else 0
            start += total
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1
        self.bases = np.concatenate([[0], np.cumsum([r[1] for r in self.rows])]).astype(np.int64)
        self.keys = np.frombuffer(b"".join(r[4] for r in self.rows), "<u4")
        self._ready = True

    @property
    def n(self) -> int:
        return sum(r[1] for r in self.rows)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return self.at[(keys >> 16) % max(1, self.n_buckets)]

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level has its bit."""
        self._prepare()
        out = np.full(len(keys), -1, np.int64)
        bucket = self._bucket(keys)
        left = np.flatnonzero(bucket >= 0)
        for level in range(len(self.sizes)):
            b = bucket[left]
            size = self.sizes[level, b]
            left, b, size = left[size > 0], b[size > 0], size[size > 0]
            bit = self.starts[level, b] + (_mixed(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[bit]
            out[left[hit]] = self.rank[bit[hit]]
            left = left[~hit]
        return out

    def numbers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys that belong to these buckets, and their
        numbers; a key that belongs here but isn't stored is an error."""
        self._prepare()
        own = np.flatnonzero(self._bucket(keys) >= 0)
        at = self._numbers(keys[own])
        if len(own) and ((at < 0).any() or (self.keys[at] != keys[own]).any()):
            raise ValueError("a linked pair is missing from the table of pairs")
        return own, at

    def set_counts(self, vectors: dict[int, bytes]) -> None:
        self.counts = np.concatenate([np.frombuffer(vectors[r[0]], "<i8") for r in self.rows]) if self.rows else np.zeros(0, np.int64)

    def best(self) -> np.ndarray:
        """The highest count of each A id."""
        self._prepare()
        out = np.zeros(1 << 16, np.int64)
        np.maximum.at(out, self.keys >> 16, self.counts)
        return out


# --- the passes ------------------------------------------------------------------


def pair_counts(texts: DataFrame, files: tuple[str, str]) -> DataFrame:
    """``pair`` (A id * 65536 + B id) of all linked pairs of ``text``, and
    ``n_docs``: the documents of a part of a task that hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, held, waiting = Memory(aligner(*files), False), [], 0
        for b in batches:
            for found in memory.pair_counts(b["text"].tolist()):
                held.append(found)
                waiting += len(found[0])
                if waiting > _HELD:
                    held = [_merged(held)]
                    waiting = len(held[0][0])
                    if waiting > _HELD // 2:
                        yield _count_rows(*held[0])
                        held, waiting = [], 0
        if held:
            yield _count_rows(*_merged(held))

    return texts.select("text").mapInPandas(run, "pair long, n_docs long")


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its counts."""
    pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in held]))
    return pairs, counts


def _count_rows(pairs: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"pair": pairs.astype(np.int64), "n_docs": counts})


def hash_buckets(pairs: DataFrame, n_buckets: int) -> DataFrame:
    """``bucket, n, sizes, bits, keys``: one minimal perfect hash a row."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, ordered = build_hash(np.sort(rows["pair"].to_numpy(np.int64)).astype(np.uint32))
        return pd.DataFrame(
            {"bucket": [key[0]], "n": [len(ordered)], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()], "keys": [ordered.astype("<u4").tobytes()]}
        )

    bucket = F.pmod(F.shiftright("pair", 16), F.lit(n_buckets)).cast("long")
    return pairs.groupBy(bucket.alias("bucket")).applyInPandas(build, "bucket long, n long, sizes array<long>, bits binary, keys binary")


def count_vectors(counted: DataFrame, table: PairTable) -> DataFrame:
    """``bucket, part, vector``: the sums of a task's rows of ``pair, n_docs``
    for each pair of the table."""
    shared = counted.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = shared.value
        counts = np.zeros(pairs.n, np.int64)
        for b in batches:
            own, at = pairs.numbers(b["pair"].to_numpy(np.int64).astype(np.uint32))
            np.add.at(counts, at, b["n_docs"].to_numpy(np.int64)[own])
        if pairs.n:
            part = TaskContext.get().partitionId()
            for (bucket, *_), start, end in zip(pairs.rows, pairs.bases, pairs.bases[1:]):
                if counts[start:end].any():
                    yield pd.DataFrame({"bucket": [bucket], "part": [part], "vector": [counts[start:end].astype("<i8").tobytes()]})

    return counted.mapInPandas(run, "bucket long, part long, vector binary")


DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def look_up(docs: DataFrame, id_col: str, table: PairTable, files: tuple[str, str]) -> DataFrame:
    """``id_col`` and the ``DOCUMENT`` columns; ``n_best`` and ``count_sum``
    over the pairs of the table."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = shared.value
        best = pairs.best()

        def sums(facts: np.ndarray, links: np.ndarray) -> np.ndarray:
            """``n_best, count_sum`` of each chunk."""
            of_links = np.zeros((2, len(links) + 1), np.int64)
            own, at = pairs.numbers(links)
            counts = pairs.counts[at]
            of_links[:, own + 1] = counts == best[links[own] >> 16], counts
            return np.diff(np.cumsum(of_links, axis=1)[:, np.cumsum(facts[N_LINKS])], prepend=0)

        memory = Memory(aligner(*files), True, sums)
        names = [c.split()[0] for c in DOCUMENT.split(", ")]
        for b in batches:
            out = []
            for at in memory.documents(b["text"].tolist()):
                facts = memory.facts[:, at].sum(axis=1)
                if not len(at) or facts[LOST]:
                    out.append((0, 0, 0, 0, 0, 0, ""))
                    continue
                groups = "".join(map(memory.groups.__getitem__, at.tolist()))[:-1]
                digest = hashlib.sha256(groups.encode()).hexdigest()
                out.append((*facts[1:].tolist(), *memory.derived[:, at].sum(axis=1).tolist(), digest))
            yield pd.DataFrame({id_col: b[id_col]} | {c: [o[i] for o in out] for i, c in enumerate(names)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInPandas(run, f"`{id_col}` {kind}, {DOCUMENT}")


def align_tokenizers(
    docs: DataFrame,
    ranks: str,
    pieces: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    pairs_per_block: int = PAIRS_PER_BLOCK,
    pairs_per_bucket: int = PAIRS_PER_BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """Per document ``id_col`` and the ``DOCUMENT`` columns; and the table
    ``a, b, n_docs`` of all linked pairs."""
    files = (ranks, pieces)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = cut_lineage(pair_counts(docs, files))
    pairs = cut_lineage(held.select("pair").distinct())
    n_buckets = max(1, math.ceil(pairs.count() / pairs_per_bucket))
    hashed = cut_lineage(hash_buckets(pairs, n_buckets))
    release(pairs)

    blocks: list[list[int]] = []
    room = 0
    for r in hashed.select("bucket", "n").orderBy("bucket").toLocalIterator():
        if not blocks or r["n"] > room:
            blocks.append([])
            room = pairs_per_block
        blocks[-1].append(r["bucket"])
        room -= r["n"]
    if len(blocks) > 1:
        docs = cut_lineage(docs.withColumn("row", F.monotonically_increasing_id()))

    out = counted = None
    for block in blocks or [[]]:
        here = hashed.where(F.col("bucket").between(block[0], block[-1])) if block else hashed.limit(0)
        table = PairTable(n_buckets, [tuple(r) for r in here.orderBy("bucket").collect()])
        partials = cut_lineage(count_vectors(held, table))
        n_parts = partials.agg(F.max("part")).first()[0]
        sums = cut_lineage(tree_sum(partials, "<i8", 1 if n_parts is None else n_parts + 1))
        release(partials)
        table.set_counts({r["bucket"]: r["vector"] for r in sums.collect()})
        names = sums.join(here, "bucket").select("keys", "vector")
        counted = names if counted is None else counted.unionByName(names)
        if len(blocks) < 2:
            out = look_up(docs, "id", table, files)
        else:
            found = look_up(docs.withColumn("id", F.struct("row", "id")), "id", table, files)
            out = found if out is None else out.unionByName(found)
    release(held)
    if len(blocks) > 1:
        same = [F.any_value(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
        added = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
        out = out.groupBy("id").agg(*same, *added).withColumn("id", F.col("id.id"))
    names = [c.split()[0] for c in DOCUMENT.split(", ")]
    return out.select(F.col("id").alias(id_col), *names), _pair_rows(counted)


def _pair_rows(counted: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, vector in zip(b["keys"], b["vector"]):
                k = np.frombuffer(keys, "<u4").astype(np.int64)
                yield pd.DataFrame({"a": k >> 16, "b": k & 0xFFFF, "n_docs": np.frombuffer(vector, "<i8")})

    return counted.mapInPandas(run, "a long, b long, n_docs long")


def tokenizer_align_query(docs: DataFrame) -> DataFrame:
    return align_tokenizers(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))[0]
