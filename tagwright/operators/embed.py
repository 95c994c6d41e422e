"""Response embeddings.

The reference encodes responses with a neural sentence encoder in batches and
L2-normalises the vectors.  Here the Spark job around any encoder is
:func:`embed_with`: ``mapInPandas`` over Arrow batches with the encoder built
once per Python worker.  The default encoder, :func:`with_hashed_embedding`, needs
no model file: a signed hashed bag of lower-cased word tokens, L2-normalised
(so it is also checkable in SQL).  It is
*not* equal in meaning to a neural encoder; it is a deterministic stand-in
that keeps the pipeline runnable end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame  # noqa: F401
from pyspark.sql import functions as F

from ..functions.regex import WORD_RUN

DIMS = 64
#: tokens a task remembers before it starts anew (about 15 MB); only speed depends on it
KNOWN_TOKENS = 1 << 16
#: rows that a worker holds at a time: texts can be long
ARROW_ROWS = "1000"


class _Codes(dict):
    """Token -> its bucket, plus ``dims`` if its sign is negative: bucket and
    sign are the first 32 bits and the next bit of the token's md5."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode()).digest()
        code = self[token] = int.from_bytes(digest[:4], "big") % self.dims + (self.dims if digest[4] & 128 else 0)
        return code


def hashed_vector(text: Column, dims: int = DIMS) -> Column:
    """Signed hashed bag of words of one text, L2-normalised (see
    :func:`with_hashed_embedding`).  Lower-casing and token matching stay in
    the JVM; the tokens of a row cross once, as one string."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = _Codes(dims)
        for batch in batches:
            out = []
            for tokens in batch:
                if len(codes) > KNOWN_TOKENS:
                    codes.clear()
                at = np.fromiter(map(codes.__getitem__, tokens.split(" ") if tokens else ()), np.int64)
                n = np.bincount(at, minlength=2 * dims)
                v = (n[:dims] - n[dims:]).astype(np.float64)
                norm = np.sqrt((v * v).sum())
                out.append((v / norm if norm > 0 else v).astype(np.float32))
            yield pd.Series(out, dtype=object)

    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_RUN), 0)
    return vectors(F.array_join(tokens, " "))


def with_hashed_embedding(
    df: DataFrame, key_col: str, text_col: str = "assistant_output", dims: int = DIMS, out: str = "embedding"
) -> DataFrame:
    """Signed hashed bag of words, L2-normalised, ``array<float>`` of ``dims``
    (a null or empty text gives the zero vector), ``key_col`` first.

    A row's vector is worked out from its own text alone: no explode, shuffle
    or join back, and rows with a null or repeated key stay as they are.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    others = [c for c in df.columns if c not in (key_col, out)]
    return df.select(key_col, *others, hashed_vector(F.col(text_col), dims).alias(out))


def embed_with(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    text_col: str = "assistant_output",
    out: str = "embedding",
) -> DataFrame:
    """T14 with any encoder: ``make_encoder()`` runs once per Python worker
    and returns ``encode(texts) -> float matrix``; vectors are L2-normalised
    and stored as ``array<float>`` next to the row (no positional files)."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for pdf in batches:
            vecs = np.asarray(encode(pdf[text_col].astype(str).tolist()), dtype=np.float64)
            norms = np.linalg.norm(vecs, axis=1, keepdims=True)
            vecs = np.divide(vecs, norms, out=np.zeros_like(vecs), where=norms > 0).astype(np.float32)
            pdf[out] = list(vecs)
            yield pdf

    return df.mapInPandas(fn, schema)


def unit_norm_violations(df: DataFrame, col: str = "embedding", tol: float = 1e-5) -> int:
    """Invariant for T14: rows whose non-zero vector is not of unit length."""
    n2 = F.aggregate(F.col(col), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return df.where((n2 > 0) & (F.abs(F.sqrt(n2) - 1) > tol)).count()
