"""SimHash fingerprints and their exact near-duplicate classes, by tiles of equal population counts.

A fingerprint's tile is the population counts of its four 16-bit quarters. Fingerprints within the radius have counts
that differ by no more than the radius in sum, so only such tile pairs are compared; a tile of more than ``BLOCK``
fingerprints is cut into blocks, so no task gets a whole hot tile. Inside a task, numpy takes the exclusive or of a
block with its visitors and counts bits. Equal texts are one fingerprint before anything is compared, so a
group of copies costs one row.

Edge cases: a null text is an empty one; texts without words have fingerprint zero and link like others; a class takes the
least doc_id that is not null; repeated rows and doc_ids stay as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cytolake.llm.components import components
from cytolake.runtime import cut_lineage

SEED = 42
RADIUS = 2
BLOCK = 2048
PARTS = 4


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    rows = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in rows), "<u8", max(1, len(words) - shingle + 1))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series(np.array([fingerprint_of(t) for t in s], np.uint64).view(np.int64))


def _tile(fp: Column) -> Column:
    """Population counts of the quarters, five bits each; no sum of a count and a radius reaches 32."""
    bits = 64 // PARTS
    counts = [F.bit_count(F.shiftrightunsigned(fp, bits * k).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))) for k in range(PARTS)]
    return sum((c * (32 ** k) for k, c in enumerate(counts)), F.lit(0))


def _steps(radius: int) -> list[int]:
    """Differences of tile codes within the radius, one of each opposite pair."""
    out = {0}
    for d in product(range(-radius, radius + 1), repeat=PARTS):
        if 0 < sum(map(abs, d)) <= radius and next(x for x in d if x) > 0:
            out.add(sum(x * 32 ** k for k, x in enumerate(d)))
    return sorted(out)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block as a star per class: every node with the least node it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _links(fp: np.ndarray, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray] | None:
    bits = fp.view(np.uint64)                      # bits of negative numbers are counted of their absolute value
    inside, inside_bits, a, b = fp[member], bits[member], [], []
    step = max(1, (1 << 22) // max(1, len(inside)))
    for at in range(0, len(fp), step):
        rows = fp[at:at + step]
        i, j = np.nonzero(np.bitwise_count(bits[at:at + step, None] ^ inside_bits[None, :]) <= radius)
        other = rows[i] != inside[j]
        if other.any():
            x, y = _roots(rows[i[other]], inside[j[other]])
            a.append(x[x != y])
            b.append(y[x != y])
    return (np.concatenate(a), np.concatenate(b)) if a else None


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(rows[0])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, rows.shape[1]]):
                if hi - lo > 1 and (found := _links(np.ascontiguousarray(rows[1, lo:hi]), rows[2, lo:hi] == 1, radius)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            if not rows.shape[1]:
                continue
            rows = np.concatenate([*kept, rows], axis=1)
            cuts = np.flatnonzero(np.diff(rows[0]))
            if not len(cuts):                      # one tile block so far; its size is bounded by its visitors
                kept = [rows]
                continue
            yield from out(rows[:, :cuts[-1] + 1])
            kept = [rows[:, cuts[-1] + 1:]]
        if kept:
            yield from out(kept[0])
    return run


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``fingerprint`` rows -> edges (a, b) that connect all those within ``radius`` bits, a star per block and class."""
    spark = prints.sparkSession
    tiled = prints.select("fingerprint", _tile(F.col("fingerprint")).alias("tile"))
    tiles = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    step = F.explode(F.array(*[F.lit(x) for x in _steps(radius)])).alias("step")
    visits = (tiled.select("fingerprint", step, (F.col("tile") + F.col("step")).alias("tile"))
              .join(F.broadcast(tiles), "tile")   # no more than 17^4 tiles exist, whatever the input
              .select("fingerprint", "step", "tile", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    own = (F.col("step") == 0) & (F.pmod(F.xxhash64("fingerprint"), F.col("blocks")) == F.col("block"))
    rows = visits.select((F.col("block").cast("long") * (1 << 20) + F.col("tile")).alias("place"), "fingerprint", own.cast("int").alias("own"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "place").sortWithinPartitions("place")
            .mapInArrow(_compare(radius), "a bigint, b bigint"))


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, row) rows -> (fingerprint, first): the least ``row`` of the fingerprint's class."""
    prints = cut_lineage(marked.groupBy("fingerprint").agg(F.min("row").alias("row")))
    roots = cut_lineage(components(near_links(prints, radius)))
    rooted = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "row", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("row").alias("first"))
    return rooted.join(least, "root").select("fingerprint", "first")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    marked = cut_lineage(docs.select("doc_id", fingerprint("text").alias("fingerprint")))
    found = classes(marked.select("fingerprint", F.col("doc_id").alias("row")), radius)
    return marked.join(found, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each class of near-duplicates, the one with the least doc_id (nulls last, then any one), with its columns only."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    stored = cut_lineage(docs.select(whole, F.col("doc_id").alias("id"), fingerprint("text").alias("fingerprint"),
                                     F.monotonically_increasing_id().alias("at")))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "at").alias("row")
    found = classes(stored.select("fingerprint", rank), radius)
    return stored.join(found.select(F.col("first.at").alias("at")).distinct(), "at", "left_semi").select("doc.*")
