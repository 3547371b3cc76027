"""Ordinal quality classifier: a cumulative-link regression on hashed words.

One weight per hashed token is shared by all grades; ordered thresholds cut the score: P(grade <= k) = s(t_k - w.x). The model
gives the expected grade and the probability of the top grade, by which documents are selected.

Tokens are runs of word characters in lower case, the beginnings of longer ones, and runs of other characters; a document has a token or not, so its
length does not matter. Training uses at most ``SAMPLE`` labelled rows, those with the least hashes (``sample`` sets
another bound); scoring reads every whole text. Near copies among those rows share the weight of one. All tokens of those rows enter the
model, whichever way they speak. Their weights have a normal prior, wider the more a token's mean grade differs from the mean
(z standard errors: ``WIDE`` z^2 / (z^2 + ``HALF``)), so that chance tokens of long texts do not drown the few that count.

Edge cases: a null text is an empty one and gets the prior grade; labels without a document, and rows with a null rating, are not
used; an id labelled twice with different grades counts with each; with fewer than two grades in the labels the model has no
tokens and knows the prior only; with no labels at all grades are null and nothing is selected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cytolake.llm.simhash import _links, fingerprint_of

TOKEN = re.compile(r"\w+|[^\w\s]+")
SPACE = (1 << 28) - 1
SAMPLE = 8000
WIDE, HALF = 2.5, 25.0
ALIKE = 6      # bits between the fingerprints of near copies
REMEMBER = 1 << 19


def hashed(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & SPACE


def tokens_of(text: str | None) -> set[str]:
    """Tokens of a text, the first four characters of longer words, and a mark for words said three times in a row."""
    words = TOKEN.findall((text or "").lower())
    out = set(words)
    out.update([f"^{w[:4]}" for w in out if len(w) > 4])
    again = sum(a == b == c and a.isalnum() for a, b, c in zip(words, words[1:], words[2:]))
    if again:
        out.add("<again>" if 5 * again < len(words) else "<mostly again>")
    return out


@dataclass
class Ordinal:
    thresholds: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            total = 0.0
            for w in sorted(tokens_of(t)):
                x = cache.get(w)
                if x is None:
                    if len(cache) >= REMEMBER:
                        cache.clear()
                    x = cache[w] = self.weights.get(hashed(w), 0.0)
                total += x
            out[i] = total
        return out

    def upto(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all grades but the top one."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))


def _weights(prints: np.ndarray) -> np.ndarray:
    """One over the size of each row's class of near copies; the rows are a bounded sample."""
    known, at = np.unique(prints, return_inverse=True)
    root, links = np.arange(len(known)), _links(known, np.ones(len(known), bool), ALIKE)
    if links:
        i, j = (np.searchsorted(known, x) for x in links)
        while True:
            low, new = np.minimum(root[i], root[j]), root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return 1.0 / np.bincount(root[at], minlength=len(known))[root[at]]


def fit(rows: list[tuple[list[int], int, int]], grades: int, rounds: int = 300) -> Ordinal:
    """Most probable weights by full gradient steps (Adam, falling step size), over rows of (hashed tokens, grade, fingerprint)."""
    y = np.array([g for _, g, _ in rows], np.int64)
    w = _weights(np.array([p for _, _, p in rows], np.int64))
    ridge = 1 / w.sum()                   # a prior of variance one, beside the mean loss of so many texts
    w /= w.sum()
    share = np.array([np.clip(w[y <= k].sum(), 1e-3, 1 - 1e-3) for k in range(grades - 1)])
    start = np.log(share / (1 - share))
    start += 1e-3 * np.arange(grades - 1)
    if len(set(y.tolist())) < 2:
        return Ordinal(start)
    sizes = np.array([len(tokens) for tokens, _, _ in rows])
    chosen, col = np.unique(np.fromiter((t for tokens, _, _ in rows for t in tokens), np.int64, int(sizes.sum())), return_inverse=True)
    doc = np.repeat(np.arange(len(y)), sizes)
    mean = float((w * y).sum())
    sd = float(np.sqrt((w * (y - mean) ** 2).sum()))
    count = np.bincount(col, w[doc] / ridge, len(chosen))
    off = np.bincount(col, (w * (y - mean))[doc] / ridge, len(chosen))
    z2 = (off / sd) ** 2 / count
    wide = WIDE * z2 / (z2 + HALF)
    # thresholds as a first one and log gaps, so that they stay in order
    z = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-3)), np.zeros(len(chosen))])
    m, v, k = np.zeros_like(z), np.zeros_like(z), grades - 1
    one, edge = np.arange(len(y)), np.zeros((len(y), 1))
    for step in range(1, rounds + 1):
        gaps = np.exp(z[1:k])
        t = np.cumsum(np.concatenate([z[:1], gaps]))
        s = np.bincount(doc, (wide * z[k:])[col], len(y))
        below = 1 / (1 + np.exp(np.clip(s[:, None] - t, -500, 500)))
        upto = np.concatenate([edge, below, edge + 1], axis=1)
        p = np.maximum(upto[one, y + 1] - upto[one, y], 1e-12)
        slope = np.concatenate([edge, below * (1 - below), edge], axis=1)
        hi, lo = w * slope[one, y + 1] / p, w * slope[one, y] / p
        g_t = np.array([lo[y == j + 1].sum() - hi[y == j].sum() for j in range(k)])
        tail = np.cumsum(g_t[::-1])[::-1]
        g_w = wide * np.bincount(col, (hi - lo)[doc], len(chosen))
        g = np.concatenate([tail[:1], tail[1:] * gaps, g_w + ridge * z[k:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        z = z - 0.1 * (1 - (step - 1) / rounds) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Ordinal(np.cumsum(np.concatenate([z[:1], np.exp(z[1:k])])), dict(zip(chosen.tolist(), (wide * z[k:]).tolist())))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        ids = [sorted({hashed(w) for w in tokens_of(t)}) for t in texts]
        prints = np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column(1), pa.array(prints)], names=["tokens", "grade", "print"])


def train(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, sample: int = SAMPLE) -> Ordinal | None:
    """Fit on a bounded sample of labelled rows. ``grade``: 0 to grades - 1, from columns of ``labels``."""
    rated = labels.select("doc_id", grade.cast("int").alias("grade")).filter("doc_id is not null and grade is not null").distinct()
    rated = rated.orderBy(F.xxhash64("doc_id", "grade"), "doc_id", "grade").limit(sample)
    joined = docs.select("doc_id", "text").join(rated, "doc_id").select("text", "grade")
    found = joined.mapInArrow(_tokens, "tokens array<int>, grade int, print bigint").collect()
    rows = sorted((r.tokens, r.grade, r["print"]) for r in found)
    return fit(rows, grades) if rows else None


def score(docs: DataFrame, model: Ordinal | None, at_least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, top_probability and selected of every document."""
    schema = "doc_id bigint, expected_grade double, top_probability double, selected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            n = batch.num_rows
            if model is None:
                cols = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([False] * n)]
            else:
                upto = model.upto(model.scores(batch.column(1).to_pylist(), cache))
                top = 1 - upto[:, -1]
                cols = [pa.array((1 - upto).sum(axis=1)), pa.array(top), pa.array(top >= at_least)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "expected_grade", "top_probability", "selected"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
