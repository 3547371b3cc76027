"""Benchmark decontamination: which test items are contained in which documents.

Containment of an item in a document is the share of the item's distinct five-word shingles that the document has. Each
item is kept as the part of its MinHash order that cannot be missed: of n shingles, the n - ceil(0.8 n) + 1 with the
least hashes. A document that holds 0.8 of the item holds at least one of those, so the search loses nothing,
however long the document. Items are partitioned by size (number of shingles, powers of two). Every partition has its own sketch table and its own
least number of shingles, 0.8 of its smallest size, and is searched only for documents that have so many shingles of words that items use; inside a partition the
sketch of an item is as long as its size demands. Every document with a sketch hit is then verified on the exact shingles of the item.

Items travel to the tasks in parts of at most ``PART`` shingles, one pass over the documents for each part, so a large
benchmark costs passes, never memory.

Words are runs of letters, digits and underscores in lower case, so punctuation and case do not hide a passage. Items of
fewer than five words are one shingle of all their words. Edge cases: null or wordless items match nothing; null
texts are empty; repeated item rows count once per item_id; items of one id with different texts each count, the best
containment is reported; an empty table gives no rows; clashing extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SHINGLE = 5
CONTAINMENT = 0.8
PART = 1 << 21
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles_of(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def _mix(codes: np.ndarray) -> np.ndarray:
    """Rows of word numbers -> 64-bit hashes; the MinHash order of shingles."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


class Partition:
    """Items of one shingle length whose number of shingles lies in [2^(b-1), 2^b): a sketch table and the least shingles of a match."""

    def __init__(self, b: int, threshold: float):
        self.least = max(1, math.ceil(threshold * (1 << (b - 1)) - 1e-9))
        self.items: dict[int, list[int]] = defaultdict(list)
        self.keys = np.empty(0, np.uint64)

    def close(self) -> None:
        self.keys = np.array(sorted(self.items), np.uint64)

    def hits(self, hashes: np.ndarray) -> Iterator[int]:
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        for x in hashes[self.keys[place] == hashes]:
            yield from self.items[int(x)]


class Items:
    """Items of one part, ready for lookups: word numbers, size partitions by shingle length, exact shingles."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = CONTAINMENT):
        self.numbers: dict[str, int] = {}
        self.ids: list[int] = []
        self.exact: list[np.ndarray] = []
        self.threshold = threshold
        found_in: dict[int, dict[int, Partition]] = defaultdict(dict)
        for item_id, text in rows:
            found = shingles_of(words_of(text))
            if not found:
                continue
            codes = np.array([[self.numbers.setdefault(w, len(self.numbers) + 1) for w in s] for s in sorted(found)], np.int64)
            h = np.sort(_mix(codes))
            at, n = len(self.ids), len(h)
            self.ids.append(item_id)
            self.exact.append(codes)
            part = found_in[codes.shape[1]].setdefault(n.bit_length(), Partition(n.bit_length(), threshold))
            for x in h[:n - math.ceil(threshold * n - 1e-9) + 1]:
                part.items[int(x)].append(at)
        #: shingle length -> partitions by ascending size
        self.partitions = {k: [parts[b] for b in sorted(parts)] for k, parts in found_in.items()}
        for parts in self.partitions.values():
            for part in parts:
                part.close()

    @property
    def sizes(self) -> dict[int, list[int]]:
        """Shingle length -> the least shingles of a document for each of its partitions."""
        return {k: [part.least for part in parts] for k, parts in self.partitions.items()}

    def fitting(self, k: int, shingles: int) -> list[Partition]:
        """The partitions that a document with so many shingles of length k can match."""
        return [part for part in self.partitions[k] if part.least <= shingles]

    def matches(self, text: str | None) -> Iterator[tuple[int, float]]:
        words = words_of(text)
        codes = np.fromiter((self.numbers.get(w, 0) for w in words), np.int64, len(words))
        if not codes.any():
            return
        near: set[int] = set()
        for k in self.partitions:
            if len(codes) < k:
                continue
            # only runs of k words that all occur in items can be a shingle of one
            known = np.flatnonzero(np.convolve(codes > 0, np.ones(k, np.int64), "valid") == k)
            if not len(known) or not self.fitting(k, len(known)):
                continue
            h = np.unique(_mix(codes[known[:, None] + np.arange(k)]))
            for part in self.fitting(k, len(h)):
                near.update(part.hits(h))
        if not near:
            return
        have: dict[int, set[bytes]] = {}
        for at in sorted(near):
            exact = self.exact[at]
            k = exact.shape[1]
            if k not in have:
                known = np.flatnonzero(np.convolve(codes > 0, np.ones(k, np.int64), "valid") == k) if len(codes) >= k else np.empty(0, np.int64)
                have[k] = {r.tobytes() for r in codes[known[:, None] + np.arange(k)]}
            share = sum(r.tobytes() in have[k] for r in exact) / len(exact)
            if share >= self.threshold - 1e-9:
                yield self.ids[at], share


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for i, c in items.matches(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))],
                                                 names=["doc_id", "item_id", "containment"])
    return run


def _parts(benchmark: DataFrame) -> Iterator[Items]:
    """Items in parts of bounded size; part numbers come from running sizes of hash buckets, so no part depends on row order."""
    sized = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null").distinct()
    words = F.greatest(F.lit(1), F.length("text") / 2)
    total = sized.agg(F.sum(words)).first()[0] or 0
    parts = max(1, math.ceil(2 * total / PART))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for p in range(parts):
        rows = sized.filter(part == p).orderBy("item_id", "text").collect()
        if rows:
            yield Items([(r[0], r[1]) for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, containment): every document and item with containment of 0.8 or more."""
    texts, found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), None
    for items in _parts(benchmark):
        one = texts.mapInArrow(_search(items), "doc_id bigint, item_id bigint, containment double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return texts.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, containment double")
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no item, decided row by row on the text, with their columns."""
    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])     # any names will do outside
    for items in _parts(benchmark):
        kept = kept.mapInArrow(_clean(items, docs.columns.index("text")), kept.schema)
    return kept.toDF(*docs.columns)


def _clean(items: Items, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            good = pa.array([next(items.matches(t), None) is None for t in texts], pa.bool_())
            yield batch.filter(good)
    return run
