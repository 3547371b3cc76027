"""Hidden Markov language model over words, trained by Baum-Welch on all training documents.

Symbols: the ``OWN`` most frequent training words each have their own; all other words share ``SHARED`` symbols by a hash of their last
three bytes, which tells languages and word forms apart; the end of a document has one. A state emits symbols; a shared
symbol then stands for one of its words with (c + 0.5) / (n + 0.5 (v + 1)), c the word's count, n and v the tokens and words
of the symbol in training. So every word, known or not, has a probability, and those of all words sum to one.

Counts of all words stay in a table that grows with the corpus. The ``COMMON`` most frequent words travel with the
tasks; the rest meets its counts in one join by word, in which no word is hot, since the hot ones are the common ones.

Training: starting values come from a bounded sample; each round then reads all training documents, every task adds up expected
counts (forwards and backwards over stretches of ``STRETCH`` tokens), Spark sums them over all tasks, and the model, of
bounded size, is set from the sums. Rounds end when the likelihood grows by less than ``GAIN`` a token, however many they are; it
is bounded, so they end. Scoring runs the scaled forward recursion over every whole document.

Edge cases: a null text is an empty one, its only token the end; a null doc_id is hashed as an empty text; without training
documents no word is known and all models are uniform; repeated rows count as often as they occur and are scored each.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cytolake.runtime import cut_lineage, number_rows

STATES, OWN, SHARED, COMMON = 6, 1 << 14, 1 << 13, 1 << 17
STRETCH, SAMPLE, SAMPLE_TOKENS = 512, 2000, 4096
GAIN = 2e-3
START_ROUNDS = 20
FLUSH = 1 << 19
SYMBOLS = OWN + SHARED + 1
END = SYMBOLS - 1
PRIOR = 20.0          # weight of the symbol's overall share in each state's emissions, in tokens
TABLE = ("at bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, shared_logs double, symbols binary, "
         "rare array<struct<word:binary,n:int>>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def shared_symbol(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SHARED


# --- words and their counts -------------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return made

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(words_of(text))
            seen[b""] += 1                       # the end
            if len(seen) >= FLUSH:
                yield out()
    if seen:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents; the empty word is the end."""
    parts = docs.filter(~held_out(F.col("doc_id"))).select("text").mapInArrow(_count, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """What a task needs to know of the counts: the common words, and the sizes of shared symbols."""
    tokens: int
    distinct: int
    ends: int
    common: dict[bytes, int]              # word -> rank; the first OWN have their own symbol
    counts: np.ndarray
    sizes: np.ndarray                     # log10 of n + 0.5 (v + 1) for each shared symbol
    symbol_counts: np.ndarray

    @property
    def base(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))


def summarise(counts: DataFrame) -> Words:
    """Totals, the common words and symbol sizes; all of bounded size."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    real = counts.filter("length(word) > 0")
    level = F.floor(F.log2("n") * 8).cast("int")                  # a few hundred levels at most
    levels = real.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    taken, lowest, cut = 0, None, None
    for r in levels:
        if taken + r.words > COMMON:
            cut = r.level
            break
        taken, lowest = taken + r.words, r.level
    found = real.filter(level >= lowest).toArrow() if lowest is not None else real.limit(0).toArrow()     # COMMON rows at most
    top = list(zip((-x for x in found.column("n").to_pylist()), found.column("word").to_pylist()))
    if cut is not None and taken < COMMON:                        # the level that does not fit gives its first words, ranked over all tasks
        ranked = number_rows(real.filter(level == cut), [], [F.desc("n"), F.asc("word")], "rank").filter(F.col("rank") <= COMMON - taken)
        found = ranked.select("word", "n").toArrow()
        top += zip((-x for x in found.column("n").to_pylist()), found.column("word").to_pylist())
    top.sort()
    ends = counts.filter("length(word) = 0").first()
    own = top[:OWN]
    rest = real
    if own:
        n, word = -own[-1][0], F.lit(own[-1][1])
        rest = real.filter((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word)))
    bucket = F.crc32(F.expr("substring(word, -3)")) % SHARED
    n, v = np.zeros(SHARED), np.zeros(SHARED)
    for r in rest.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r.b], v[r.b] = r.n, r.v
    symbol_counts = np.concatenate([[-x for x, _ in own], np.zeros(OWN - len(own)), n, [ends.n if ends else 0]])
    return Words(tokens, distinct, ends.n if ends else 0, {w: i for i, (_, w) in enumerate(top)},
                 np.array([-x for x, _ in top], np.int64), np.log10(n + 0.5 * (v + 1)), symbol_counts)


def _translate(words: Words):
    """(at, doc_id, held_out, text) -> the rows of TABLE: symbols, sums over common words, and rare words with their numbers."""
    logs = np.log10(np.concatenate([words.counts, [0]]) + 0.5)
    end_log = math.log10(words.ends + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, tails = words.common.get, {}

        def tail(word: bytes) -> int:
            key = word[-3:]
            found = tails.get(key)
            if found is None:
                found = tails[key] = shared_symbol(word)
            return found

        ranked = np.array([tail(w) for w in words.common], np.int64) if words.common else np.zeros(0, np.int64)
        symbol_of = np.where(np.arange(len(ranked)) < OWN, np.arange(len(ranked)), OWN + ranked)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows: dict[str, list] = {k: [] for k in ("n_tokens", "known", "logs", "shared_logs", "symbols", "rare")}
                for text in part.column(3).to_pylist():
                    found = words_of(text)
                    rank = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
                    symbols = np.empty(len(found) + 1, np.uint16)
                    symbols[-1] = END
                    common = rank >= 0
                    symbols[:-1][common] = symbol_of[rank[common]]
                    late = [found[i] for i in np.flatnonzero(~common)]
                    symbols[:-1][~common] = [OWN + tail(w) for w in late]
                    shared = symbols[symbols < END]
                    shared = shared[shared >= OWN].astype(np.int64) - OWN
                    rows["n_tokens"].append(len(symbols))
                    rows["known"].append(int(common.sum()) + (words.ends > 0))
                    rows["logs"].append(float(logs[rank[common]].sum()) + end_log)
                    rows["shared_logs"].append(float(logs[rank[rank >= OWN]].sum() - words.sizes[shared].sum()))
                    rows["symbols"].append(symbols.tobytes())
                    rows["rare"].append([{"word": w, "n": n} for w, n in Counter(late).items()])
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *[pa.array(v, k) for v, k in zip(rows.values(), kinds)]],
                                                 names=["at", "doc_id", "held_out", *rows])
    return run


# --- the model --------------------------------------------------------------------------------------------------------

@dataclass
class Model:
    first: np.ndarray        # K
    step: np.ndarray         # K x K
    emit: np.ndarray         # SYMBOLS x K


def _batches(rows: list[np.ndarray], cells: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences by falling length, as (time x sequences) matrices: indices, lengths, symbols."""
    order = np.argsort([-len(r) for r in rows], kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, len(rows[order[at]]))
        take = order[at:at + max(1, min(1024, cells // longest))]
        sizes = np.array([len(rows[i]) for i in take])
        block = np.zeros((longest, len(take)), np.int64)
        for j, i in enumerate(take):
            block[:sizes[j], j] = rows[i]
        yield take, sizes, block
        at += len(take)


def forward(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    """Natural log of each sequence's probability, by the scaled recursion; states are summed at every step."""
    out = np.zeros(len(rows))
    for take, sizes, block in _batches(rows):
        active = np.searchsorted(-sizes, -np.arange(len(block)), "left")
        total, a = np.zeros(len(take)), None
        for t in range(len(block)):
            n = active[t]
            e = model.emit[block[t, :n]]
            a = (model.first if a is None else a[:n] @ model.step) * e
            c = a.sum(axis=1)
            a /= c[:, None]
            total[:n] += np.log(c)
        out[take] = total
    return out


def expected(model: Model, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch sums over sequences: first states, steps, emissions, log likelihood."""
    k = len(model.first)
    first, step, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS, k)), 0.0
    for _, sizes, block in _batches(rows):
        long, wide = block.shape
        active = np.searchsorted(-sizes, -np.arange(long), "left")
        alpha, e, c = np.zeros((long, wide, k)), model.emit[block], np.ones((long, wide))
        for t in range(long):
            n = active[t]
            a = (model.first if t == 0 else alpha[t - 1, :n] @ model.step) * e[t, :n]
            c[t, :n] = a.sum(axis=1)
            alpha[t, :n] = a / c[t, :n, None]
        total += float(np.log(c).sum())
        beta = np.ones((wide, k))
        for t in range(long - 1, 0, -1):
            n = active[t]
            w = e[t, :n] * beta[:n] / c[t, :n, None]
            step += alpha[t - 1, :n].T @ w
            alpha[t, :n] *= beta[:n]              # now the state's share
            beta[:n] = w @ model.step.T
        alpha[0] *= beta
        first += alpha[0].sum(axis=0)
        inside = np.arange(long)[:, None] < sizes[None, :]
        symbols = block[inside]
        for j in range(k):
            emit[:, j] += np.bincount(symbols, alpha[..., j][inside], SYMBOLS)
    return first, step * model.step, emit, total


def maximise(first: np.ndarray, step: np.ndarray, emit: np.ndarray, overall: np.ndarray, seen: np.ndarray | None = None) -> Model:
    """Parameters from sums; each state's emissions lean on the overall shares, and symbols not ``seen`` in training have just those."""
    emit = emit + PRIOR * overall[:, None]
    if seen is not None:
        emit[~seen] = 0
        known = emit.sum(axis=0)
        emit *= np.divide(1 - overall[~seen].sum(), known, where=known > 0, out=np.zeros_like(known))
        emit[~seen] = overall[~seen, None]
    step = step + 0.1
    first = first + 0.1
    return Model(first / first.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _stretches(raw: list[bytes]) -> list[np.ndarray]:
    out = []
    for x in raw:
        s = np.frombuffer(x, np.uint16)
        out.extend(s[i:i + STRETCH] for i in range(0, len(s), STRETCH))
    return out


def start(rows: list[np.ndarray], overall: np.ndarray, seen: np.ndarray) -> Model:
    """Starting values from a sample: sequences in groups far from each other, then rounds on the sample alone.

    Seeds are chosen one after another, each the sequence worst explained by the seeds so far.
    """
    model = maximise(np.ones(STATES), np.ones((STATES, STATES)) + 20 * STATES * np.eye(STATES), np.zeros((SYMBOLS, STATES)), overall, seen)
    if not rows:
        return model
    counts = [np.bincount(r, minlength=SYMBOLS).astype(np.float32) for r in rows if len(r) >= 64][:400]
    emits, best = [], None
    for j in range(STATES if counts else 0):
        if best is None:
            pick = int(np.argmax([c.sum() for c in counts]))
        else:
            pick = int(np.argmin(best))
        emits.append((counts[pick] + 5 * overall * 20) / (counts[pick].sum() + 100))
        fit_ = np.array([float(c[c > 0] @ np.log(emits[-1][c > 0] / overall[c > 0])) / float(c.sum()) for c in counts])
        best = fit_ if best is None else np.maximum(best, fit_)
    if emits:
        model.emit = np.stack(emits, axis=1)
        model.emit /= model.emit.sum(axis=0)
    for _ in range(START_ROUNDS):
        first, step, emit, _ = expected(model, rows)
        model = maximise(first, step, emit, overall, seen)
    return model


def _sum(model: Model):
    """Per task: expected counts as rows (symbol, c0 ... ck-1); steps and the rest have negative symbols."""
    names = [f"c{j}" for j in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
        like, n, held = 0.0, 0, []

        def work() -> None:
            nonlocal first, step, emit, like
            f, s, e, x = expected(model, held)
            first, step, emit, like = first + f, step + s, emit + e, like + x
            held.clear()

        size = 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.extend(_stretches([raw]))
                size += len(raw) // 2
                n += len(raw) // 2
                if size >= 1 << 20:
                    work()
                    size = 0
        if held:
            work()
        if n:
            some = np.flatnonzero(emit.any(axis=1))
            keys = np.concatenate([some, -2 - np.arange(STATES), [-1, -100]])
            data = np.concatenate([emit[some], step, [first], [[like, n] + [0.0] * (STATES - 2)]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(data[:, j]) for j in range(STATES)]], names=["symbol", *names])
    return run


def _sample(training: DataFrame) -> list[bytes]:
    """The symbols of about ``SAMPLE`` training rows: those whose hash is below a bound that the number of rows sets, so every task
    finds its own and no others leave it; rows that are equal count once."""
    short, mark = training.filter(F.col("n_tokens") <= SAMPLE_TOKENS), F.xxhash64("doc_id", "n_tokens", "symbols")
    rows = short.count()
    bound = (1 << 63) - 1 if rows <= SAMPLE else (SAMPLE << 64) // rows - (1 << 63)
    chosen = short.select("symbols", mark.alias("mark")).filter(F.col("mark") <= bound).groupBy("mark").agg(F.first("symbols").alias("symbols"))
    return [bytes(r.symbols) for r in sorted(chosen.collect(), key=lambda r: r.mark)]


def fit(table: DataFrame, words: Words) -> tuple[Model, int]:
    """Train on the rows of TABLE that are not held out until the rounds rest; how many there were."""
    seen = words.symbol_counts > 0
    shares = words.symbol_counts + np.where(np.arange(SYMBOLS) < OWN, 0.0, 0.5)
    overall = shares / shares.sum()
    training = table.filter("not held_out")
    model = start(_stretches(_sample(training)), overall, seen)
    names, before, rounds = [f"c{j}" for j in range(STATES)], None, 0
    while True:
        sums = (training.select("symbols").mapInArrow(_sum(model), "symbol int, " + ", ".join(f"{c} double" for c in names))
                .groupBy("symbol").agg(*[F.sum(c).alias(c) for c in names]).collect())
        if not sums:
            return model, rounds
        emit, step, first = np.zeros((SYMBOLS, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
        like = 0.0
        for r in sums:
            row = [r[c] for c in names]
            if r.symbol >= 0:
                emit[r.symbol] = row
            elif r.symbol == -100:
                like = row[0] / row[1]
            elif r.symbol == -1:
                first = np.array(row)
            else:
                step[-2 - r.symbol] = row
        model, rounds = maximise(first, step, emit, overall, seen), rounds + 1
        if before is not None and not like - before >= GAIN:
            return model, rounds
        before = like


def _score(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.uint16) for x in batch.column(batch.schema.get_field_index("symbols")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(forward(model, rows) / math.log(10))],
                                             names=[*names, "hmm"])
    return run


def score_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; rounds counts those over all training text."""
    counts = cut_lineage(word_counts(docs))
    words = summarise(counts)
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    table = cut_lineage(rows.mapInArrow(_translate(words), TABLE))
    model, rounds = fit(table, words)
    rare = table.select("at", F.explode("rare").alias("r")).select("at", "r.word", F.col("r.n").alias("times"))
    met = rare.join(counts, "word", "left")
    sums = met.groupBy("at").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"),
                                 F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    names = ["at", "doc_id", "held_out", "n_tokens", "known", "logs", "shared_logs"]
    kinds = ", ".join(x.strip() for x in TABLE.split(", ")[:7])
    scored = table.select(*names, "symbols").mapInArrow(_score(model, names), kinds + ", hmm double")
    extra, known = F.coalesce("rare_logs", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return scored.join(sums, "at", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + known).alias("n_known"), F.lit(words.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * words.base).alias("base_score"), (F.col("hmm") + F.col("shared_logs") + extra).alias("score"),
        F.lit(rounds).alias("rounds"))
