"""Packing: sum-of-squares online packing into windows of fixed length.

One pass turns every document into piece rows: whole windows as long as they
last, then the remainder, each with the checksum of its ids; no text or id
moves afterwards.  The piece rows, in arrival order, are cut into packers of a
bounded number of tokens and pieces.  A packer keeps a level array (how many
partially filled windows there are at each fill) and puts a piece into the
fill level that makes the sum of the squared counts smallest, ties to the
fullest.  At the end of its stream the pieces of the windows left partly
filled are placed once more, longest first, into the fullest level that holds
them.

Ids of the byte-level vocabulary; each document ends with id ``1``.  A packer
needs its piece rows and the level array only.  Packers follow the arrival
order (``order_col``, or the order of reading), which is written down before
the pieces are dealt out, so a repeated task packs the same way.

Edge cases: null text is empty, which leaves the end id alone; repeated rows
are packed like any other; empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .pieces import byte_ids, tokenizer_path

WINDOW = 2_048
END_ID = 1
PACKER_TOKENS = 1 << 25
PACKER_PIECES = 1 << 18
_PIECE_SCHEMA = "doc_id long, arrival long, start long, length long, ids_crc32 long, doc_tokens long"
_OUT_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Online packing by a level array; ``place`` returns (window, offset)."""

    def __init__(self, size: int, first_window: int = 0):
        self.size = size
        self.next_window = first_window
        # counts[h]: open windows filled to h; a full window costs nothing, so its entry stands at -1/2
        self.counts = np.zeros(size + 1, dtype=np.float64)
        self.counts[size] = -0.5
        self.open: dict[int, list[int]] = {}

    def _move(self, level: int, length: int) -> tuple[int, int]:
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window, self.next_window = self.next_window, self.next_window + 1
        if (to := level + length) < self.size:
            self.open.setdefault(to, []).append(window)
            self.counts[to] += 1
        return window, level

    def place(self, length: int) -> tuple[int, int]:
        """The level whose choice makes the sum of squared counts smallest:
        moving a window from h to h + s changes it by 2 (N[h+s] - N[h]) + 2,
        a new window by 2 N[s] + 1."""
        size, counts = self.size, self.counts
        if length == size:
            return self._move(0, length)
        held = counts[1 : size - length + 1]
        change = np.where(held > 0, counts[1 + length :] - held, np.inf)[::-1]
        best = int(change.argmin())
        if change[best] <= counts[length] - 0.5:
            return self._move(size - length - best, length)
        return self._move(0, length)

    def place_tightly(self, length: int) -> tuple[int, int]:
        """The fullest level that holds the piece."""
        fits = np.flatnonzero(self.counts[1 : self.size - length + 1] > 0)
        return self._move(int(fits[-1]) + 1 if len(fits) else 0, length)


def pack_lengths(lengths: np.ndarray, size: int, first_window: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length, in arrival order."""
    packer = SumOfSquares(size, first_window)
    window = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    for i, s in enumerate(lengths.tolist()):
        window[i], offset[i] = packer.place(s)
    left = np.array(sorted(w for ws in packer.open.values() for w in ws), dtype=np.int64)
    again = np.flatnonzero(np.isin(window, left))
    again = again[np.argsort(-lengths[again], kind="stable")]
    tight = SumOfSquares(size, 0)
    for i in again.tolist():
        w, offset[i] = tight.place_tightly(int(lengths[i]))
        window[i] = packer.next_window + w
    # gapless numbers
    _, window = np.unique(window, return_inverse=True)
    return window.astype(np.int64) + first_window, offset


def document_pieces(
    docs: DataFrame, path: str, window: int = WINDOW, order_col: str | None = "doc_id", id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_ids(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, arrival, text in zip(b["doc_id"], b["arrival"], b["text"]):
                ids = np.append(encoder.ids(text), np.uint32(END_ID)).astype("<u4", copy=False)
                n = len(ids)
                for at in range(0, n, window):
                    part = ids[at : at + window]
                    rows.append((doc, arrival, at, len(part), zlib.crc32(part.tobytes()), n))
            out = pd.DataFrame(rows, columns=["doc_id", "arrival", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    arrival = F.monotonically_increasing_id() if order_col is None else F.col(order_col).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(arrival, F.lit(-1)).alias("arrival"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInPandas(run, _PIECE_SCHEMA)


def pack(
    docs: DataFrame,
    path: str,
    window: int = WINDOW,
    order_col: str | None = "doc_id",
    packer_tokens: int = PACKER_TOKENS,
    packer_pieces: int = PACKER_PIECES,
    **columns: str,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  ``order_col``: arrival order; None for the order
    in which the rows are read."""
    pieces = cut_lineage(document_pieces(docs, path, window, order_col, **columns))
    size = pieces.agg(F.sum("length").alias("t"), F.count(F.lit(1)).alias("n")).first()
    packers = max(1, -(-(size["t"] or 0) // packer_tokens), -(-size["n"] // packer_pieces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        first = TaskContext.get().partitionId() << 40
        rows["sequence_id"], rows["offset"] = pack_lengths(rows["length"].to_numpy(), window, first)
        yield rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # ties in the arrival order (repeated ids) are dealt out by the row number of the written table
    dealt = pieces.withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(packers, "arrival", "row").sortWithinPartitions("arrival", "row")
    return dealt.drop("row").mapInPandas(run, _OUT_SCHEMA)


def packing_query(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path("byte_bpe_50k.tiktoken"))
