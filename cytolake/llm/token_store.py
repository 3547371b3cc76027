"""Token ids in compressed blocks with a shared zstandard dictionary.

Format, a folder that Spark writes and any Parquet reader opens:

* ``dictionary``: one row (dict_hash, dictionary), the hash being the SHA-256 of the bytes;
* ``blocks``: rows (shard, block, dict_hash, width, first_doc, last_doc, doc_ids, tokens, offsets, data). Documents ascend over shard,
  block and place in the block. Document i of a block is the zstandard frame ``data[offsets[i]:offsets[i + 1]]`` of its
  ids as little-endian numbers of ``width`` bytes; ``tokens[i]`` counts the ids of the shard's documents before it, and
  ``tokens[n]`` those up to the end of the block. One document is read without its neighbours.

The dictionary is trained on at most ``SAMPLE`` documents of at most ``SAMPLE_CHARS`` characters, those with the least hashes; it decides how
small the files are, never what is read back. Words as the tokenizer's own splitting rule finds them are encoded once and
remembered by each worker; a text with characters outside the Latin blocks goes to the tokenizer whole, so no result
rests on two Unicode tables agreeing.

Edge cases: a null text is an empty one and has the end id alone; rows without a doc_id come first; equal doc_ids are
ordered by a hash of the text; repeated rows stay; an empty table gives empty folders; clashing extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

SAMPLE, SAMPLE_CHARS, DICTIONARY = 2048, 16384, 1 << 16
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
REMEMBER = 1 << 20
#: The tokenizer's splitting rule over Latin letters, where the classes are the same in every Unicode version.
_LATIN = [chr(c) for c in [*range(0x20, 0x7f), *range(0xa1, 0x250)]]
_LETTERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_DIGITS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
SPLIT = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
ELSEWHERE = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")
PLAIN = re.compile(rf" [{_LETTERS}]+")
BLOCKS = ("shard int, block int, dict_hash string, width int, first_doc bigint, last_doc bigint, doc_ids array<bigint>, "
          "tokens array<bigint>, offsets array<bigint>, data binary")


class Encoder:
    """A byte-level tokenizer of the tokenizers library that remembers the words it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # the tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None      # in a text they are one id each, as the library has it
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}

    def _bytes(self, texts: Sequence[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Encode new words. Those of a space and letters go in one text, which the tokenizer splits into just these words."""
        if len(self.known) + len(words) > REMEMBER:
            self.known.clear()
        plain = [w for w in words if PLAIN.fullmatch(w)]
        rest = list(words.difference(plain))
        self.known.update(zip(rest, self._bytes(rest)))
        if plain:
            e = self.tokenizer.encode("".join(plain), add_special_tokens=False)
            ids, at = np.array(e.ids, f"<u{self.width}"), np.array(e.word_ids)
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(ids)]
            data, w = ids.tobytes(), self.width
            self.known.update(zip(plain, [data[lo * w:hi * w] for lo, hi in zip(cuts, cuts[1:])], strict=True))

    def encode(self, texts: Iterable[str | None], end: int | None = 0) -> list[bytes]:
        """Ids of each text, as little-endian numbers of ``width`` bytes, with the end id behind."""
        last = b"" if end is None else end.to_bytes(self.width, "little")
        out, new, late = [], set(), []
        for i, t in enumerate(texts):
            if t and (ELSEWHERE.search(t) or self.special and self.special.search(t)):
                out.append(self._bytes([t])[0] + last)
                continue
            words = SPLIT.findall(t) if t else []
            found = list(map(self.known.get, words))
            if None in found:
                new.update([w for w, x in zip(words, found) if x is None])
                late.append((i, words, found))
                out.append(b"")
            else:
                out.append(b"".join(found) + last)
        if new:
            self._learn(new)
            for i, words, found in late:
                out[i] = b"".join([self.known[w] if x is None else x for w, x in zip(words, found)]) + last
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text in ascending order over as many ranges as the session has shuffle partitions."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("doc_id", "tie")
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
            .repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text"))


def train(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary from the serialized ids of a sample of about ``SAMPLE`` rows: those whose hash is below a bound that the number of rows
    sets, so every task finds its own; rows that are equal count once."""
    rows, mark = docs.count(), F.xxhash64("text", "doc_id")
    bound = (1 << 63) - 1 if rows <= SAMPLE else (SAMPLE << 64) // rows - (1 << 63)
    sample = (docs.select("text", mark.alias("mark")).filter(F.col("mark") <= bound).filter(F.length("text").between(1, SAMPLE_CHARS))
              .groupBy("mark").agg(F.first("text").alias("text")).select("text", "mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_encoder(tokenizer).encode(batch.column(0).to_pylist()), pa.binary()), batch.column(1)], names=["ids", "mark"])

    samples = [bytes(r.ids) for r in sorted(sample.mapInArrow(run, "ids binary, mark bigint").collect(), key=lambda r: r.mark)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:                    # too little to train on: the samples themselves
        return b"".join(samples)[:DICTIONARY]


def _dictionary(data: bytes, level: int | None = None) -> dict:
    if not data:
        return {}
    shared = zstandard.ZstdCompressionDict(data)
    if level is not None:
        shared.precompute_compress(level=level)
    return {"dict_data": shared}


def _pack(tokenizer: str, dictionary: bytes, end: int | None):
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = _encoder(tokenizer), zstandard.ZstdCompressor(level=3, **_dictionary(dictionary, 3))
        shard, block, seen = TaskContext.get().partitionId(), 0, 0
        ids, frames, sizes, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal block, seen, held
            tokens = np.cumsum([seen, *sizes])
            known = [d for d in ids if d is not None]
            row = {"shard": shard, "block": block, "dict_hash": digest, "width": encoder.width,
                   "first_doc": min(known, default=None), "last_doc": max(known, default=None), "doc_ids": list(ids), "tokens": tokens.tolist(),
                   "offsets": np.cumsum([0, *map(len, frames)]).tolist(), "data": b"".join(frames)}
            block, seen, held = block + 1, int(tokens[-1]), 0
            ids.clear(), frames.clear(), sizes.clear()
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist(), end)):
                    ids.append(doc_id)
                    frames.append(press.compress(raw))
                    sizes.append(len(raw) // encoder.width)
                    held += len(frames[-1])
                    if len(ids) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                        yield out()
        if ids:
            yield out()
    return run


ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.string()), ("width", pa.int32()), ("first_doc", pa.int64()),
                   ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())),
                   ("offsets", pa.list_(pa.int64())), ("data", pa.binary())])


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = 0) -> None:
    """Encode every text and write the folder, in ascending order of doc_id."""
    spark, dictionary = docs.sparkSession, train(docs, tokenizer)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    _ordered(docs).mapInArrow(_pack(tokenizer, dictionary, end), BLOCKS).write.parquet(f"{path}/blocks")


def _frames(row: dict, dictionary: bytes) -> Iterator[np.ndarray]:
    if row["dict_hash"] != hashlib.sha256(dictionary).hexdigest():
        raise ValueError("the block was written with another dictionary")
    open_ = zstandard.ZstdDecompressor(**_dictionary(dictionary))
    data, at = memoryview(row["data"]), row["offsets"]
    for lo, hi in zip(at, at[1:]):
        yield np.frombuffer(open_.decompress(data[lo:hi]), f"<u{row['width']}")


def _load(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)


def _starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard; a row for each shard."""
    last = blocks.groupBy("shard").agg(F.max(F.element_at("tokens", -1)).alias("ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return last.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    dictionary, blocks = _load(spark, path), spark.read.parquet(f"{path}/blocks")
    placed = blocks.join(F.broadcast(_starts(blocks)), "shard")      # shards are as many as the partitions that wrote them
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in _frames(row, dictionary)]
                tokens = np.array(row["tokens"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(tokens[:-1] + row["before"]),
                                                  pa.array(np.diff(tokens)), pa.array(crcs, pa.int64())], schema=schema)

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of some: then only blocks that may hold one are read, and only its frames opened."""
    dictionary, blocks = _load(spark, path), spark.read.parquet(f"{path}/blocks")
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        here = F.lit(False)
        for d in sorted(wanted):
            here |= (F.col("first_doc") <= d) & (F.col("last_doc") >= d)
        blocks = blocks.filter(here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor(**_dictionary(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                for i, d in enumerate(row["doc_ids"]):
                    if wanted is None or d in wanted:
                        raw = open_.decompress(row["data"][row["offsets"][i]:row["offsets"][i + 1]])
                        ids = np.frombuffer(raw, f"<u{row['width']}").astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, ids array<bigint>")
