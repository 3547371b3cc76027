"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reports, at every position, all pieces that end there, longest first, by following its output links; each
relaxes the best score of that position, and strictly better wins, so of equal scores the longest last piece stays.
The segmentation has the greatest sum of piece scores, as in the library's unigram mode. Characters that are no
piece become byte pieces and cost less than nothing else can make up for. A space goes to the front, as the model
asks, and comes off when decoding; a literal lower-one-eighth block (the mark that stands for a space) is written as bytes, so decoding gives every
text back exactly.

No piece holds a space after another character, nor a line end, so the best path of a text is made of the best paths of its
words; those are remembered, up to ``REMEMBER`` of them per worker.

Edge cases: a null text has no pieces (decoded: null), an empty one none; repeated rows stay; other columns pass through, but
one named like an output column is replaced; the model travels with the tasks (half a megabyte).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, types as T

MARK = "▁"
CHUNK = re.compile(r"\n| *[^ \n]+| +")
REMEMBER = 1 << 19
ADDED = [("piece_ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("round_trip", T.BooleanType())]


class Pieces(dict):
    """A model; as a dict, the words seen so far with their ids as bytes."""

    def __init__(self, model: bytes):
        super().__init__()
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton, self.written, self.single = ahocorasick.Automaton(), [], set()
        self.byte_ids = {}
        lowest = 0.0
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.written.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.written.append(b"")
            else:
                plain = piece.replace(MARK, " ")
                if "\n" in plain or " " in plain.lstrip(" "):
                    raise ValueError(f"piece {i} crosses words")
                self.written.append(plain.encode())
                self.automaton.add_word(plain, (len(plain), i, lib.get_score(i)))
                lowest = min(lowest, lib.get_score(i))
                if len(plain) == 1:
                    self.single.add(plain)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        self.automaton.make_automaton()
        self.penalty = lowest - 10.0

    def best_path(self, word: str) -> list[int]:
        n = len(word)
        best, step, piece = [float("-inf")] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        best[0], done = 0.0, 0
        for end, (size, i, score) in self.automaton.iter(word):
            while done < end:
                done += 1
                self._fallback(word, best, done)
            reached = best[end + 1 - size] + score
            if reached > best[end + 1]:
                best[end + 1], step[end + 1], piece[end + 1] = reached, size, i
        while done < n:
            done += 1
            self._fallback(word, best, done)
        out, at = [], n
        while at:
            if piece[at] < 0:
                out.extend(self.byte_ids[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass")))
            else:
                out.append(piece[at])
            at -= step[at]
        return out[::-1]

    def _fallback(self, word: str, best: list[float], at: int) -> None:
        if word[at - 1] not in self.single and best[at] == float("-inf"):
            best[at] = best[at - 1] + self.penalty

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.best_path(word), "<i4").tobytes()
        if len(word) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return b"".join(map(self.__getitem__, CHUNK.findall(" " + text))) if text else b""

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


@functools.lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def _encode(model: bytes, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text).to_pylist()
                ids = [np.frombuffer(pieces.encode(t), "<i4") for t in texts]
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                                 pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))
                same = pa.array([None if t is None else pieces.decode(x.tolist()) == t for t, x in zip(texts, ids)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(sizes), same], names=[*part.schema.names, *dict(ADDED)])
    return run


def _mapped(df: DataFrame, function, added: list[tuple[str, T.DataType]]) -> DataFrame:
    """``mapInArrow`` that adds columns behind the others; inside, those are called by position, so any names will do."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType(plain.schema.fields + [T.StructField(n, t) for n, t in added])
    return plain.mapInArrow(function, schema).toDF(*df.columns, *[n for n, _ in added])


def _read(model_path: str) -> bytes:
    with open(model_path, "rb") as f:      # a file of the driver's installation, not one of the inputs
        return f.read()


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Add piece_ids, n_pieces and round_trip (whether decoding the ids gives the text back)."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in dict(ADDED)])
    return _mapped(kept, _encode(_read(model_path), kept.columns.index("text")), ADDED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Add ``decoded``: the text of ``piece_ids``."""
    kept = encoded.select(*[f"`{c}`" for c in encoded.columns if c != "decoded"])
    model, at = _read(model_path), kept.columns.index("piece_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            texts = pa.array([None if x is None else pieces.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return _mapped(kept, run, [("decoded", T.StringType())])
