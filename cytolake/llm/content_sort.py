"""Exact duplicates by a content sort: sampled splitters deal out ranges of the normalised bytes, an external sort places
equal texts side by side, and every text is compared in full with its neighbour.

A text's place in the order is its first ``HEAD`` bytes, then its SHA-256, then the bytes themselves and the identifier. Splitters are
drawn from (head, digest, identifier), so they are short whatever the texts, documents behind one long common beginning still
spread, and a group of copies as large as a third of all rows is cut into ranges like anything else. A run of equal texts that touches
the border of its range is stitched to the neighbouring range by comparing the two texts at the border; that table has at most two rows a range.
Inside a task only the identifiers of the open run and one text are held.

Edge cases: a null text is an empty one, and empty texts are equal to each other; a null identifier counts as less than any other and stays only
if its whole group has none; of repeated identifiers in a group one row stays; an empty table gives no rows; other columns, whatever their names, are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from cytolake.runtime import cut_lineage

HEAD = 32


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, at, text) -> (id, at, head, sha, text): A-Z in lower case, which ``bytes.lower`` does for ASCII letters only."""
    for batch in batches:
        texts = [(t or b"").lower() for t in batch.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([t[:HEAD] for t in texts], pa.binary()),
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(texts, pa.binary())],
            names=["id", "at", "head", "sha", "text"])


def _same_as_before(sha: pa.Array, text: pa.Array, before: tuple[bytes, bytes] | None) -> np.ndarray:
    """Of every row, whether its text equals the one before it; bytes are compared wherever digests agree."""
    digests = sha.to_pylist()
    same = np.zeros(len(digests), bool)
    if before is not None:
        same[0] = digests[0] == before[0] and text[0].as_py() == before[1]
    for i in range(1, len(digests)):
        if digests[i] == digests[i - 1]:
            same[i] = text[i].as_buffer().equals(text[i - 1].as_buffer())
    return same


def _rows(ids: pa.Array, at: pa.Array, sha: pa.Array, starts: np.ndarray, part: int, place: int, text: bytes | None = None) -> pa.RecordBatch:
    """Rows of whole runs that begin at ``starts``: the run's last identifier, its length, and whether a row is the last."""
    n = len(ids)
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    last = np.zeros(n, bool)
    last[ends - 1] = True
    texts = pa.nulls(n, pa.binary()) if text is None else pa.array([None] * (n - 1) + [text], pa.binary())
    return pa.RecordBatch.from_arrays(
        [ids, at, sha, pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, place, np.int32)),
         ids.take(pa.array(np.repeat(ends - 1, sizes))), pa.array(np.repeat(sizes, sizes)), pa.array(last), texts],
        names=["id", "at", "sha", "part", "place", "keep_id", "n", "last", "text"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range. ``place`` is 0 for a run inside it, 1 for its first run, 2 for its last and 3 if there is one run only."""
    part, before, held, first = TaskContext.get().partitionId(), None, [], True

    def close(place: int) -> pa.RecordBatch:
        ids, at = (pa.concat_arrays([h[k] for h in held]) for k in range(2))
        return _rows(ids, at, pa.array([before[0]] * len(ids), pa.binary()), np.zeros(1, np.int64), part, place, before[1] if place else None)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, at, sha, text = (batch.column(k) for k in (0, 1, 3, 4))
        starts = np.flatnonzero(~_same_as_before(sha, text, before))
        if not len(starts):
            held.append((ids, at))
            continue
        lo, hi = int(starts[0]), int(starts[-1])
        if before is not None:
            held.append((ids[:lo], at[:lo]))
            yield close(int(first))
            first = False
        if hi > lo and first:              # the range's first run lies whole in this batch
            lo = int(starts[1])
            yield _rows(ids[:lo], at[:lo], sha[:lo], np.zeros(1, np.int64), part, 1, text[0].as_py())
            first = False
        if hi > lo:
            yield _rows(ids[lo:hi], at[lo:hi], sha[lo:hi], starts[(starts >= lo) & (starts < hi)] - lo, part, 0)
        held, before = [(ids[hi:], at[hi:])], (sha[hi].as_py(), text[hi].as_py())
    if before is not None:
        yield close(3 if first else 2)


def _stitched(found: DataFrame) -> DataFrame:
    """(part, place, whole_keep, whole_n, ends): for every run at a border, the group it is part of, and whether the group ends with it.

    At most two rows a range, so the two windows over all of them are small whatever the input.
    """
    borders = cut_lineage(found.filter("place > 0 AND last").select("part", "place", "keep_id", "n", "text"))
    ordered = cut_lineage(borders.select("part", "place", "keep_id", "n", F.row_number().over(W.orderBy("part", "place")).alias("at")))
    texts = ordered.join(borders.select("part", "place", "text"), ["part", "place"]).select("at", "text")
    before = texts.select((F.col("at") + 1).alias("at"), F.col("text").alias("text_before"))
    joined = texts.join(before, "at").filter("text = text_before").select("at", F.lit(0).alias("fresh"))
    chained = ordered.join(joined, "at", "left").withColumn("chain", F.sum(F.coalesce("fresh", F.lit(1))).over(W.orderBy("at")))
    whole = chained.groupBy("chain").agg(F.max_by("keep_id", "at").alias("whole_keep"), F.sum("n").alias("whole_n"), F.max("at").alias("end"))
    return chained.join(whole, "chain").select("part", "place", "whole_keep", "whole_n", (F.col("at") == F.col("end")).alias("ends"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", at=None) -> DataFrame:
    """A row per row of ``docs``: id, at, keep_id (of the row that stays), group_size, kept, text_sha256 of the normalised text.

    ``keep`` says which identifier of a group stays, ``smallest`` or ``largest``. ``at`` tells equal rows apart (their position by default).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    spark = docs.sparkSession
    at = F.monotonically_increasing_id() if at is None else at
    rows = docs.select(F.col(key).alias("id"), at.alias("at"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    order = F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut_lineage(
        rows.mapInArrow(_normalised, f"id {kind}, at bigint, head binary, sha binary, text binary")
        .repartitionByRange(ranges, "head", "sha", order, "at").sortWithinPartitions("head", "sha", "text", order, "at")
        .mapInArrow(_runs, f"id {kind}, at bigint, sha binary, part int, place int, keep_id {kind}, n bigint, last boolean, text binary"))
    inside = F.col("place") == 0
    return found.drop("text").join(F.broadcast(_stitched(found)), ["part", "place"], "left").select(
        "id", "at", F.when(inside, F.col("keep_id")).otherwise(F.col("whole_keep")).alias("keep_id"),
        F.when(inside, F.col("n")).otherwise(F.col("whole_n")).alias("group_size"),
        (F.col("last") & (inside | F.coalesce("ends", F.lit(False)))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    return groups(docs, keep=keep).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    stored = cut_lineage(docs.select(whole, F.monotonically_increasing_id().alias("at")))
    flat = stored.select("doc.doc_id", "doc.text", "at")
    stays = groups(flat, keep=keep, at=F.col("at")).filter("kept").select("at")
    return stored.join(stays, "at", "left_semi").select("doc.*")
