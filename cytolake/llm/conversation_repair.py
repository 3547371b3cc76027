"""Repair of conversation structure by a weighted interval parse.

The grammar of role letters ``(s?(ua)+)?`` in Chomsky normal form has a symbol for every pair of states of that pattern: p -> q is what a
span of rows may become so that it leads from state p to state q, and the only binary rule is (p -> q) = (p -> r)(r -> q). A row
alone is kept, given another role or deleted; the closure over insertions stands after every row and before the first. A cell holds the
least (cost, audit) of a symbol over a span, and longer spans are put together from shorter ones, bottom-up by length. As all symbols are of this one
form, every way to split a span gives the same cell, so one split of each span is enough and spans of 1, 2, 4, ... rows suffice.
Among audits of equal cost over the same rows none is the beginning of another (it would lack an insertion, and so cost less), so the least of the
parts gives the least of the whole.

Rows are numbered inside a conversation by ranges, parsed in blocks of ``BLOCK`` rows, and the blocks' cells, of a size that follows the audit, are put together
by conversation: neither step has a whole long conversation's rows in one group. Digests stream over sorted rows.

Edge cases: null roles and texts are one space; rows of equal turn go by role, then by the MD5 of the text, null turns first; an empty role, or one
whose first letter is not s, u or a, never fits as it is; a conversation without rows after damage has zeros, an empty audit and the digest of an
empty text; a null conv_id is a conversation of its own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cytolake.runtime import cut_lineage, number_rows

BLOCK = 1024
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3

#: From each state of the pattern (nothing yet, after s, after u, after a) the letters that may follow, and where they lead.
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
Cell = dict[tuple[int, int], tuple[int, str]]


def least(cell: Cell, at: tuple[int, int], value: tuple[int, str]) -> None:
    if at not in cell or value < cell[at]:
        cell[at] = value


def combine(left: Cell, right: Cell) -> Cell:
    """(p -> q) = least of (p -> r)(r -> q)."""
    out: Cell = {}
    by: dict[int, list] = {}
    for (r, q), (cost, audit) in right.items():
        by.setdefault(r, []).append((q, cost, audit))
    for (p, r), (cost, audit) in left.items():
        for q, more, rest in by.get(r, ()):
            if (p, q) not in out or (cost + more, audit + rest) < out[p, q]:
                out[p, q] = (cost + more, audit + rest)
    return out


def _closure() -> Cell:
    """Any number of insertions: the least fixed point of (p -> q) = (p -> q)(q -> r)."""
    once: Cell = {(p, p): (0, "") for p in MOVES}
    for p, moves in MOVES.items():
        for letter, q in moves.items():
            if letter in ROLES:
                least(once, (p, q), (INSERT, "I"))
    now = once
    while (more := combine(now, once)) != now:
        now = more
    return now


INSERTIONS = _closure()


def terminal(letter: str, fault: int) -> Cell:
    """One row, followed by any number of insertions."""
    cell: Cell = {(p, p): (DELETE, "D") for p in MOVES}
    if fault not in (BLANK_FAULT, DUPLICATE_FAULT):
        extra = TRUNCATED if fault == TRUNCATED_FAULT else 0
        for p, moves in MOVES.items():
            for to, q in moves.items():
                if to == letter:
                    least(cell, (p, q), (extra, "K"))
                if to in ROLES:
                    least(cell, (p, q), (REROLE + extra, "R"))
    return combine(cell, INSERTIONS)


class Spans:
    """Spans in order; two neighbours of equal length become one, as carries do in a binary counter."""

    def __init__(self):
        self.spans: list[tuple[int, Cell]] = []

    def push(self, length: int, cell: Cell) -> None:
        self.spans.append((length, cell))
        while len(self.spans) > 1 and self.spans[-2][0] <= self.spans[-1][0]:
            self._join()

    def _join(self) -> None:
        (n, b), (m, a) = self.spans.pop(), self.spans.pop()
        self.spans.append((m + n, combine(a, b)))

    def whole(self) -> Cell:
        while len(self.spans) > 1:
            self._join()
        return self.spans[0][1] if self.spans else {(p, p): (0, "") for p in MOVES}


def damage(conversations: DataFrame) -> DataFrame:
    """The test damage, by crc32 of ``conv_id:turn`` modulo 20: rows of (conv_id, turn, role, text) after it."""
    space = F.lit(" ")
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.filter(part != 0).select(
        "conv_id", "turn", F.when(part == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(part == 1, "").when(part == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(part == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("none"))


def judged(rows: DataFrame) -> DataFrame:
    """(key, conv_id, pos, turn, role, text, letter, fault) of rows after damage; pos counts from 1 in each conversation."""
    rows = rows.select(_key(F.col("conv_id")).alias("key"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("mark", F.md5(F.col("text").cast("binary")))
    placed = cut_lineage(number_rows(rows, ["key"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")], "pos"))
    first = placed.groupBy("key", "role", "mark").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    ending = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return placed.join(first, ["key", "pos"], "left").select(
        "key", "conv_id", "pos", "turn", "role", "text", F.substring("role", 1, 1).alias("letter"),
        F.when(ending == "", BLANK_FAULT).when(F.col("first").isNull(), DUPLICATE_FAULT)
        .when(~ending.isin(".", "!", "?"), TRUNCATED_FAULT).otherwise(0).alias("fault"))


CELL = "key string, block bigint, n bigint, first string, last string, illegal bigint, states array<int>, costs array<bigint>, audits array<string>"
_CELL_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]


class _Open:
    """The group (key, block) that a sorted stream is in."""

    def __init__(self, key, block):
        self.at, self.n, self.first, self.last, self.illegal, self.spans = (key, block), 0, None, None, 0, Spans()

    def add(self, n, first, last, illegal, cell):
        if self.last is not None and self.last + first not in LEGAL:
            self.illegal += 1
        self.first = first if self.first is None else self.first
        self.last, self.n, self.illegal = last, self.n + n, self.illegal + illegal
        self.spans.push(n, cell)

    def row(self):
        cell = self.spans.whole()
        return (*self.at, self.n, self.first, self.last, self.illegal, [4 * p + q for p, q in cell], [c for c, _ in cell.values()], [a for _, a in cell.values()])


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _CELL_TYPES)], names=[f.split()[0] for f in CELL.split(", ")])


def _streamed(read):
    """Sorted rows -> a cell row per (key, block); ``read`` gives (key, block, n, first, last, illegal, cell) of a batch's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, size = None, [], 0
        for batch in batches:
            for key, block, *rest in read(batch):
                if now is None or now.at != (key, block):
                    if now is not None:
                        done.append(now.row())
                        size += now.n
                        if size > 8 * BLOCK:
                            yield _out(done)
                            done, size = [], 0
                    now = _Open(key, block)
                now.add(*rest)
        if now is not None:
            done.append(now.row())
        if done:
            yield _out(done)
    return run


def _from_rows(batch: pa.RecordBatch):
    known: dict[tuple[str, int], Cell] = {}
    for key, block, letter, fault in zip(*(c.to_pylist() for c in batch.columns)):
        if (letter, fault) not in known:
            known[letter, fault] = terminal(letter, fault)
        yield key, block, 1, letter, letter, 0, known[letter, fault]


def _from_cells(batch: pa.RecordBatch):
    for key, block, n, first, last, illegal, states, costs, audits in zip(*(c.to_pylist() for c in batch.columns)):
        yield key, 0, n, first, last, illegal, {divmod(s, 4): (c, a) for s, c, a in zip(states, costs, audits)}


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations' cells -> key, illegal, cost, audit, and the repaired rows as (pos of the row or null, letter)."""
    for batch in batches:
        out = []
        for key, _, n, first, last, illegal, states, costs, audits in zip(*(c.to_pylist() for c in batch.columns)):
            cell = combine(INSERTIONS, {divmod(s, 4): (c, a) for s, c, a in zip(states, costs, audits)})
            cost, audit = min(cell[0, q] for q in FINAL if (0, q) in cell)
            out.append((key, illegal, cost, audit))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))] if out else
                                         [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())],
                                         names=["key", "illegal", "cost", "audit"])


def parse(rows: DataFrame) -> DataFrame:
    """Judged rows -> (key, illegal, cost, audit) of every conversation that has rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor((F.col("pos") - 1) / BLOCK).cast("bigint").alias("block")
    blocks = cut_lineage(
        rows.select("key", block, "letter", "fault", "pos").repartition(n, "key", "block").sortWithinPartitions("key", "block", "pos")
        .drop("pos").mapInArrow(_streamed(_from_rows), CELL))
    return (blocks.repartition(n, "key").sortWithinPartitions("key", "block").mapInArrow(_streamed(_from_cells), CELL)
            .mapInArrow(_edits, "key string, illegal bigint, cost bigint, audit string"))


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An audit, cut into letters -> the rows that stay or come: (key, seq, pos of the row or null, new role or null).

    A row that stays has the letter that the pattern asks for; only the first letter may be s, and only a kept one.
    """
    for batch in batches:
        out = []
        for key, audit, system in zip(*(c.to_pylist() for c in batch.columns)):
            pos, seq, turn = 0, 0, "u"
            for edit in audit:
                pos += edit != "I"
                if edit == "D":
                    continue
                seq += 1
                if edit == "K" and seq == 1 and pos == system:
                    out.append((key, seq, pos, None))
                    continue
                out.append((key, seq, None if edit == "I" else pos, None if edit == "K" else ROLES[turn]))
                turn = "a" if turn == "u" else "u"
            if len(out) > 10_000:
                yield _spelled_batch(out)
                out = []
        if out:
            yield _spelled_batch(out)


def _spelled_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                      names=["key", "seq", "pos", "new_role"])


def repaired(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """(key, seq, role, text) of the repaired conversations."""
    starts = rows.filter("letter = 's'").select("key", "pos")
    kept_from = parsed.select("key", "audit", (F.length(F.regexp_extract("audit", "^D*K", 0))).cast("bigint").alias("pos"))
    system = kept_from.join(starts.withColumn("is_s", F.lit(True)), ["key", "pos"], "left").select(
        "key", "audit", F.when(F.col("is_s"), F.col("pos")).otherwise(F.lit(0)).alias("system"))
    spelled = system.mapInArrow(_spelled, "key string, seq bigint, pos bigint, new_role string")
    old = rows.select("key", "pos", "role", "text")
    return spelled.join(old, ["key", "pos"], "left").select(
        "key", "seq", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=["key", "repaired_sha256"])

    for batch in batches:
        for key, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            line = f"{role}:{text}".encode()
            if key == now:
                sha.update(b"\n" + line)
                continue
            if now is not None:
                yield row()
            now, sha = key, hashlib.sha256(line)
    if now is not None:
        yield row()


def digests(fixed: DataFrame) -> DataFrame:
    """(key, repaired_sha256): ``role:text`` of the repaired rows in order, joined by line breaks; one row of a conversation in memory at a time."""
    n = int(fixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (fixed.repartition(n, "key").sortWithinPartitions("key", "seq").select("key", "role", "text")
            .mapInArrow(_digests, "key string, repaired_sha256 string"))


def repair_table(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations``, repairs them and returns one row for every conv_id: gaps, faults, illegal pairs, cost, audit and digest."""
    rows = cut_lineage(judged(damage(conversations)))
    counts = rows.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.count_if(F.col("fault") == code).alias(name) for name, code in
          (("blank", BLANK_FAULT), ("duplicate", DUPLICATE_FAULT), ("truncated", TRUNCATED_FAULT))])
    parsed = cut_lineage(parse(rows))
    sums = digests(repaired(rows, parsed))
    every = conversations.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(counts, "key", "left").join(parsed, "key", "left").join(sums, "key", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
