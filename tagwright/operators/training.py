"""Training set of the tagger: subcluster members, capped and weakly labelled
(S6, S7, T10 and T11 together).

The responses of every subcluster that the tag matrix names are kept (members
of others have no tags and go), at most ``cap`` of each by hash order of their
keys, and every one receives all tags of its subcluster.

Scale: one scan; the matrix is broadcast after a size check, the cap moves
only counts per (subcluster, hash prefix) and then the rows up to each cut, so
a subcluster with a third of all rows is never in one task.  The result is
written once, and its guards and counts read the written rows.

Edge cases: an empty matrix, no member of any named subcluster, and missing
columns raise :class:`InputError`; a named subcluster without members is no
error and shows up in :func:`training_counts` with 0 rows; null keys are
ordered as empty ones; repeated rows count as often as they occur; other
columns pass through, but for ``tags``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..session import cut_lineage
from ..sources.readers import InputError, require_columns
from .split import cap_per_group
from .tagger import weak_labels

RESPONSE_KEY = ("source_split", "source_row", "response_index")
KEY_MARK = "\x1f"


def response_key(keys: Sequence[str] = RESPONSE_KEY):
    """The composite key as one string."""
    return F.concat_ws(KEY_MARK, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def training_set(
    responses: DataFrame,
    tag_matrix: DataFrame,
    cap: int | None = None,
    keys: Sequence[str] = RESPONSE_KEY,
    seed: int = D.SEED,
    top_col: str = "top_cluster",
    sub_col: str = "cluster",
) -> DataFrame:
    """The rows to train on, with their ``tags``."""
    require_columns(responses, [top_col, sub_col, "assistant_output", *keys], "training responses")
    if tag_matrix.isEmpty():
        raise InputError("the tag matrix names no subcluster with tags")
    members = weak_labels(responses.drop("tags"), tag_matrix, top_col, sub_col)
    members = members.withColumn("__key", response_key(keys))
    out = cut_lineage(cap_per_group(members, [top_col, sub_col], "__key", cap, seed).drop("__key"))
    if out.isEmpty():
        raise InputError("no response lies in a subcluster of the tag matrix")
    return out


def training_counts(
    training: DataFrame, tag_matrix: DataFrame, top_col: str = "top_cluster", sub_col: str = "cluster"
) -> DataFrame:
    """``top_cluster, subcluster, rows, n_tags`` of every subcluster of the matrix."""
    held = training.groupBy(F.col(top_col).alias("top_cluster"), F.col(sub_col).alias("subcluster"))
    held = held.agg(F.count(F.lit(1)).alias("rows"))
    named = tag_matrix.select("top_cluster", "subcluster", F.size("tags").alias("n_tags"))
    return named.join(held, ["top_cluster", "subcluster"], "left").select(
        "top_cluster", "subcluster", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "n_tags"
    )


__all__ = ["RESPONSE_KEY", "response_key", "training_counts", "training_set"]
