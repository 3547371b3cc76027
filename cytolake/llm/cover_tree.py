"""Product codes by Lloyd rounds over cover trees.

Vectors become integers, are cut into equal parts, and every part position gets its own codebook. Each task builds, for chunks of
its own rows and every part position, a cover tree: a node holds a point of the data and the distance to its farthest
descendant; its children cover it at half that distance, lie further apart than that, and the first of them has the same point.
Points lie in tree order, so cumulative sums give the sum of any subtree. The trees are written once and used by all rounds.

A round walks the trees level by level with the entries that can still be nearest: by the triangle inequality an entry is
out when its distance to the node exceeds the nearest one's by more than twice the node's reach. A node left with one entry gives its whole
subtree to it, by count and sum; only the others descend, and in leaves integer distances are compared exactly. Rounds shuffle sums of
(part, entry, position) only; the driver holds the codebooks, entries x dimensions numbers whatever the input.

Edge cases: rows whose vector is null, holds null or non-finite components, or has another length than the vector of the least vec_id (a positive
multiple of the number of parts) have no code and are dropped; a null vec_id is coded, but starts no entry; a repeated vec_id starts one entry, by its least vector;
fewer vec_ids than entries give fewer entries; components beyond +-2^18 count as that, the largest for which 64-bit sums of squares stay exact; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cytolake.runtime import cut_lineage, salted_join

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 26     # of a scaled component
CHUNK = 4096        # vectors under one set of trees
LEAF = 12           # points that are compared directly instead of being divided further
NODE = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("point", "<i4"), ("kid", "<i4"), ("kids", "<i4"), ("reach", "<f8")])


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a - b).astype(np.float64)
    return np.sqrt((d * d).sum(-1))


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer points -> (order of the points, nodes); a node's points are order[lo:hi], its children nodes[kid:kid + kids]."""
    n = len(points)
    order = np.arange(n)
    away = _apart(points, points[:1])           # of every point, in tree order, from the point of its lowest node
    nodes = np.zeros(1, NODE)
    nodes[0] = (0, n, 0, 0, 0, away.max())
    level = np.zeros(1, np.int64)               # nodes that may be divided
    while True:
        own = nodes[level]
        level = level[(own["hi"] - own["lo"] > LEAF) & (own["reach"] > 0)]
        if not len(level):
            return order.astype("<i4"), nodes
        own = nodes[level]
        size = (own["hi"] - own["lo"]).astype(np.int64)
        at = np.repeat(own["lo"] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())   # places in order
        node = np.repeat(np.arange(len(level)), size)
        where, dist, child = order[at], away[at], np.zeros(len(at), np.int64)
        kids, half = np.ones(len(level), np.int64), own["reach"] / 2
        centres = [(np.arange(len(level)), np.zeros(len(level), np.int64), own["point"].astype(np.int64))]
        todo = np.arange(len(at))               # rows of nodes that are not covered yet
        while True:
            begin = np.flatnonzero(np.diff(node[todo], prepend=-1))
            far = np.maximum.reduceat(dist[todo], begin)
            open_ = far > half[node[todo][begin]]
            if not open_.any():
                break
            todo = todo[np.repeat(open_, np.diff(np.append(begin, len(todo))))]
            begin = np.flatnonzero(np.diff(node[todo], prepend=-1))
            length = np.diff(np.append(begin, len(todo)))
            top = np.flatnonzero(dist[todo] == np.repeat(far[open_], length))
            top = top[np.unique(node[todo][top], return_index=True)[1]]
            fresh, which = where[todo][top], node[todo][begin]
            centres.append((which, kids[which], fresh))
            new = _apart(points[where[todo]], points[np.repeat(fresh, length)])
            closer = new < dist[todo]
            dist[todo[closer]] = new[closer]
            child[todo[closer]] = kids[node[todo[closer]]]
            kids[which] += 1
        by = np.lexsort((child, node))
        order[at], away[at] = where[by], dist[by]
        node, child = node[by], child[by]
        begin = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(child, prepend=-1) != 0))
        grown = np.zeros(len(begin), NODE)
        grown["lo"] = at[begin]
        grown["hi"] = at[begin] + np.diff(np.append(begin, len(at)))
        grown["reach"] = np.maximum.reduceat(dist[by], begin)
        which, ordinal, fresh = (np.concatenate(x) for x in zip(*centres))
        grown["point"] = fresh[np.lexsort((ordinal, which))]
        nodes["kid"][level] = len(nodes) + np.concatenate([[0], np.cumsum(kids)[:-1]])
        nodes["kids"][level] = kids
        level = len(nodes) + np.arange(len(grown))
        nodes = np.concatenate([nodes, grown])


def assign(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, hi, entry) of ranges in tree order, which together are all points: whole subtrees first, then single points."""
    front, able = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    while len(front):
        own = nodes[front]
        dist = np.where(able, _apart(points[own["point"]][:, None, :], book[None]), np.inf)
        least = dist.min(1)
        slack = 1e-9 * (least + own["reach"] + 1)               # far above rounding, so no entry is ruled out wrongly
        able = dist - own["reach"][:, None] <= (least + own["reach"] + slack)[:, None]
        sure = able.sum(1) == 1
        yield own["lo"][sure], own["hi"][sure], able[sure].argmax(1)
        leaf = ~sure & (own["kids"] == 0)
        if leaf.any():
            size = own["hi"][leaf] - own["lo"][leaf]
            at = np.repeat(own["lo"][leaf] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            exact = ((points[order[at]][:, None, :] - book[None]) ** 2).sum(-1)
            exact[~np.repeat(able[leaf], size, axis=0)] = np.iinfo(np.int64).max
            yield at, at + 1, exact.argmin(1)                   # the first of equal ones
        down = ~sure & ~leaf
        kids = nodes["kids"][front[down]].astype(np.int64)
        first = nodes["kid"][front[down]].astype(np.int64)
        front = np.repeat(first - np.concatenate([[0], np.cumsum(kids)[:-1]]), kids) + np.arange(kids.sum()) if len(kids) else first
        able = np.repeat(able[down], kids, axis=0)


def _planted(vec, dims: int):
    """(id, carried, vector) rows -> one row a chunk: identifiers, carried values, integer points and a tree for each part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            ids, carried, flat = (pa.concat_arrays([h[k] for h in held]) for k in range(3))
            points = scaled(flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            trees = [build(points[:, lo:lo + dims // PARTS]) for lo in range(0, dims, dims // PARTS)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, carried)]
            return pa.RecordBatch.from_arrays(
                [*lists, pa.array([points.astype("<i4").tobytes()]), pa.array([[o.tobytes() for o, _ in trees]]), pa.array([[t.tobytes() for _, t in trees]])],
                names=["ids", "carried", "points", "orders", "nodes"])

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, min(CHUNK, batch.num_rows - at))
                if rows + part.num_rows > CHUNK:
                    yield out()
                    held, rows = [], 0
                held.append([part.column(k) for k in range(3)])
                rows += part.num_rows
        if rows:
            yield out()
    return run


def _chunk(batch: pa.RecordBatch, i: int, dims: int):
    points = np.frombuffer(batch.column("points")[i].as_buffer(), "<i4").reshape(-1, dims).astype(np.int64)
    step = dims // PARTS
    for part in range(PARTS):
        yield (np.ascontiguousarray(points[:, part * step:(part + 1) * step]), np.frombuffer(batch.column("orders")[i][part].as_buffer(), "<i4"),
               np.frombuffer(batch.column("nodes")[i][part].as_buffer(), NODE))


def _sums(books: np.ndarray):
    """Trees -> (part, entry, position, total) of a task's rows; position -1 counts."""
    parts, entries, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, step), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for part, (points, order, nodes) in enumerate(_chunk(batch, i, parts * step)):
                    upto = np.concatenate([np.zeros((1, step), np.int64), np.cumsum(points[order], axis=0)])
                    for lo, hi, entry in assign(points, order, nodes, books[part]):
                        np.add.at(count[part], entry, hi - lo)
                        np.add.at(total[part], entry, upto[hi] - upto[lo])
        both = np.concatenate([count[:, :, None], total], axis=2)
        part, entry, at = np.nonzero(np.broadcast_to(count[:, :, None] > 0, both.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (part, entry, at - 1)] + [pa.array(both[part, entry, at])],
                                         names=["part", "entry", "position", "total"])
    return run


def _codes(books: np.ndarray):
    parts, _, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, carried = (batch.column(k)[i].values for k in range(2))
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for part, (points, order, nodes) in enumerate(_chunk(batch, i, parts * step)):
                    entry = np.zeros(len(ids), np.int64)        # in tree order
                    for lo, hi, found in assign(points, order, nodes, books[part]):
                        size = hi - lo
                        entry[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] = np.repeat(found, size)
                    code[order, part] = entry
                    error[order] += ((points[order] - books[part][entry]) ** 2).sum(1)
                text = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [ids, carried, pa.array([text[k:k + 2 * parts] for k in range(0, len(text), 2 * parts)]), pa.array(error)],
                    names=["id", "carried", "code", "error"])
    return run


def _first(kept: DataFrame, entries: int) -> list[list[float]]:
    """Vectors of the least identifiers. Identifiers are chosen first, so only the chosen rows' vectors travel."""
    ids = [r[0] for r in kept.filter("id IS NOT NULL").select("id").distinct().orderBy("id").limit(entries).collect()]
    if not ids:
        return []
    rows = kept.filter(F.col("id") <= F.lit(ids[-1])).groupBy("id").agg(F.min("vector").alias("vector"))
    return [list(r["vector"]) for r in rows.orderBy("id").collect()]


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: str = "label",
           entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, carried, code, error) of every coded row, codebooks as an array of part x entry x position)."""
    rows = vectors.select(F.col(key).alias("id"), F.col(carry).alias("carried"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0) & finite)
    first = _first(kept, entries)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "carried")]
    if not first:
        return rows.limit(0).select("id", "carried", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    dims = len(first[0])
    start = scaled(np.array([v for v in first if len(v) == dims]))
    books = start.reshape(len(start), PARTS, dims // PARTS).transpose(1, 0, 2).copy()
    trees = cut_lineage(kept.filter(F.size("vector") == dims).mapInArrow(
        _planted(vector, dims), f"ids array<{kinds[0]}>, carried array<{kinds[1]}>, points binary, orders array<binary>, nodes array<binary>"))
    for _ in range(rounds):
        sums = (trees.select("points", "orders", "nodes").mapInArrow(_sums(books), "part int, entry int, position int, total bigint")
                .groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).collect())      # entries x (dimensions + parts) rows at most
        both = np.zeros((PARTS, len(start), dims // PARTS + 1), np.int64)
        for r in sums:
            both[r["part"], r["entry"], r["position"] + 1] = r["total"]
        used = both[:, :, 0] > 0
        books[used] = both[used][:, 1:] // both[used][:, :1]
    return trees.mapInArrow(_codes(books), f"id {kinds[0]}, carried {kinds[1]}, code string, error bigint"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_table(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every coded row; ``label_error`` sums over equal labels, nulls together."""
    coded, books = encode(vectors)
    coded = cut_lineage(coded.select("id", "code", "error", F.col("carried").isNull().alias("none"),
                                     F.coalesce(F.col("carried").cast("string"), F.lit("")).alias("label")))
    sums = cut_lineage(coded.groupBy("none", "label").agg(F.sum("error").alias("label_error")))
    return salted_join(coded, sums, ["none", "label"], ["id", "code"]).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
