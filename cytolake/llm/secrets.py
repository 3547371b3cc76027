"""Secret scan: named patterns, and windows of high Shannon entropy in candidate strings. DataFrame functions only.

A candidate is a run of at least ``WINDOW`` characters of a class's alphabet. A window slides over it; the sum of
c log2 c over the window's character counts is kept up to date from the counts of the one character that leaves and the one
that enters, and log2(w) - sum / w is the entropy. A candidate with a window at or over its class's level is a
span, from the start of its first such window to the end of its last, unless the allow-list names it: placeholders,
alphabets in order, UUIDs, paths of words.

Offsets count code points, ends are exclusive. Everything is linear in the text but for sums over blocks of 256 matches, so
one text with very many matches is no trouble.

Edge cases: a null text is an empty one (no spans, the hash of an empty string; ``redact`` leaves it null); equal spans of
different kinds stay apart; repeated rows and null doc_ids keep their rows; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: kind -> pattern, the group whose length counts, its least length. Runs that are too short are left out by the pattern itself where
#: that finds the same: a run of hex digits, or AKIA with what follows, is always taken whole from its start. A short
#: assignment must still be matched and then dropped, since it uses up text in which another could begin.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]{12,}+", 0, 16),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
}
WINDOW = 20
#: class -> alphabet, least entropy in bits of a window of 20
CLASSES = {"entropy_hex": ("0-9a-fA-F", 3.0), "entropy_text": ("A-Za-z0-9+/_=-", 3.7)}
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?|redacted|(.)\1{5,}|0123456789|abcdefghij",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[^0-9]*$", r"^[^A-Za-z]*$",
    r"^/?([A-Za-z]+[/_-])+[A-Za-z]+([/_=-][0-9]{1,4})*[/_=-]?$",
)
MARK = "[secret]"
RANK = {k: i for i, k in enumerate([*BASE, *CLASSES])}
STEP = 256


def _before(computed: Column, plus, zero: Column) -> Column:
    """For each element the fold of all elements before it; two levels of blocks keep it near linear."""
    return _bind(computed, lambda values: _folds(values, plus, zero))


def _folds(values: Column, plus, zero: Column) -> Column:
    fold = lambda part: F.aggregate(part, zero, plus)
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int"))
    blocks = F.transform(starts, lambda b: fold(F.slice(values, b * STEP + 1, F.lit(STEP))))
    return _bind(blocks, lambda sums: _bind(
        F.transform(starts, lambda b: fold(F.slice(sums, F.lit(1), b))),
        lambda heads: F.transform(values, lambda _, i: plus(
            F.get(heads, F.floor(i / STEP).cast("int")),
            fold(F.slice(values, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))))))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _located(text: Column, pattern: str, group: int) -> Column:
    """Matches as (start, end, size, found): pieces between the matches give the offsets."""
    kind = "array<struct<start:int,end:int,size:int,found:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(hits):
        wide = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"),
                            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
        return _bind(F.transform(wide, lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["hit"].alias("hit"), F.length(x["part"]).alias("size"))),
                     lambda rows: _bind(
                         _before(F.transform(rows, lambda x: x["gap"] + F.length(x["hit"])), lambda a, b: a + b, F.lit(0)),
                         lambda at: F.transform(rows, lambda x, i: F.struct(
                             (F.get(at, i) + x["gap"]).alias("start"), (F.get(at, i) + x["gap"] + F.length(x["hit"])).alias("end"),
                             x["size"].alias("size"), x["hit"].alias("found")))))

    return _bind(found, lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(F.array().cast(kind)))


def _hot(found: Column, level: float) -> Column:
    """(first, last) of the windows at or over ``level``: 1-based start of the first, end of the last; nulls if none."""
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    w = F.lit(WINDOW)

    def slide(chars):
        count = lambda lo, n, c: F.size(F.filter(F.slice(chars, lo, n), lambda x: x == c))

        def one(acc, i):
            gone = F.get(chars, i - w - 1)
            left = F.when(i > w, _bind(count(i - w, w, gone), lambda c: acc["s"] + F.get(f, c - 1) - F.get(f, c))).otherwise(acc["s"])
            lo = F.greatest(F.lit(1), i - w + 1)
            s = left + _bind(count(lo, i - lo, F.get(chars, i - 1)), lambda c: F.get(f, c + 1) - F.get(f, c))
            return _bind(s, lambda now: _bind(
                (i >= w) & (F.lit(math.log2(WINDOW)) - now / w >= level - 1e-9), lambda over: F.struct(
                    now.alias("s"), F.when(over & acc["first"].isNull(), i - w + 1).otherwise(acc["first"]).alias("first"),
                    F.when(over, i).otherwise(acc["last"]).alias("last"))))

        none = F.lit(None).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), F.struct(F.lit(0.0).alias("s"), none.alias("first"), none.alias("last")), one)

    return _bind(F.filter(F.split(found, ""), lambda x: x != ""), slide)


def _of(rows: Column, kind: str) -> Column:
    return F.transform(rows, lambda x: F.struct(x["start"].alias("start"), F.lit(RANK[kind]).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _at_least(least: int):
    return lambda x: x["size"] >= least


def _unnamed(x: Column) -> Column:
    return ~F.coalesce(*[F.when(x["found"].rlike(p), F.lit(True)) for p in ALLOWED], F.lit(False))


def _hot_part(level: float):
    return lambda x: _bind(_hot(x["found"], level), lambda h: F.struct(
        (x["start"] + h["first"] - 1).alias("start"), (x["start"] + h["last"]).alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """Add ``base`` and ``secrets``: arrays of (start, rank, kind, end) by start, then kind as listed; base ones alone, and all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = docs
    for kind, (pattern, group, least) in BASE.items():
        wide = wide.withColumn(f"_{kind}", _of(F.filter(_located(text, pattern, group), _at_least(least)), kind))
    for kind, (alphabet, level) in CLASSES.items():
        runs = _located(text, f"(?<![{alphabet}])[{alphabet}]{{{WINDOW},}}+", 0)
        hot = F.transform(F.filter(runs, _unnamed), _hot_part(level))
        wide = wide.withColumn(f"_{kind}", _of(F.filter(hot, lambda x: x["start"].isNotNull()), kind))
    base = F.array_sort(F.concat(*[F.col(f"_{k}") for k in BASE]))
    return (wide.withColumn("base", base)
            .withColumn("secrets", F.array_sort(F.concat("base", *[F.col(f"_{k}") for k in CLASSES])))
            .drop(*[f"_{k}" for k in RANK]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_table(docs: DataFrame) -> DataFrame:
    """doc_id, matches by base kind, the hash of the base spans, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """Every document with its secrets replaced by ``MARK``; overlapping spans become one. Columns stay as they are;
    ``n_chars``, where there is one, follows the text."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    found = scan(docs.select(whole, "text")).drop("base")

    def rebuilt(chars):
        ends = F.transform("secrets", lambda x: x["end"])
        kept = lambda start, upto: F.slice(chars, upto + 1, F.greatest(start - upto, F.lit(0)))
        return _bind(_before(ends, lambda a, b: F.greatest(a, b), F.lit(0)), lambda upto: F.concat(
            F.array_join(F.transform("secrets", lambda x, i: F.when(F.get(upto, i) > x["start"], F.lit("")).otherwise(
                F.concat(F.array_join(kept(x["start"], F.get(upto, i)), ""), F.lit(MARK)))), ""),
            F.array_join(F.slice(chars, F.array_max(ends) + 1, F.size(chars)), "")))

    clean = F.when(F.size("secrets") > 0, _bind(F.split("text", ""), rebuilt)).otherwise(F.col("text"))
    done = found.select("_doc", clean.alias("_clean"))
    new = {"text": F.col("_clean")} | ({"n_chars": F.length("_clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*[new[c].alias(c) if c in new else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
