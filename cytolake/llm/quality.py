"""Quality rules whose limits come from the data: one mergeable quantile sketch per language, source and metric.

A sketch is a histogram over logarithmic buckets (relative error ``alpha``). Two sketches merge by adding bucket
counts, so the sketches of a language, or of everything, are sums of the sketches of its sources. Shares are taken with one more on either side,
(count + 1) / (whole + 1), so that documents without a single symbol or repeated word still differ by their length and every metric has a spread
of its own; a limit lies ``FENCE`` times the distance of the group's quartiles beyond them, counted in buckets, that is in ratios, and one bucket (the sketch's error) further. Nothing
else sets its width. A text without a single symbol, repeated line or the like is never rejected for these. A group's
quartiles are its own and its language's, weighed by its rows against ``PRIOR_ROWS``, and a language's likewise with those of all. All of it is DataFrame
operations, and the same rows always give the same limits.

Edge cases: a null text is an empty one (all counts 0, ``base_failed``); null languages and sources form groups of
their own; ``base_failed`` rows stay out of the sketches; with no rows left there are no limits and nothing more is
rejected; repeated rows count as often as they occur; other columns pass through unread, and a column of the input
that has a measured column's name is replaced in ``measure`` and kept in ``keep_good``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytolake.runtime import cut_lineage

SPACE = " \t\n\x0b\f\r"
#: metric -> what it counts
METRICS = {"word_length": "word_chars", "symbol_share": "n_symbols", "dup_line_share": "n_dup_lines", "repeat_share": "n_repeat_words", "upper_share": "n_upper"}
FENCE = 2.5
PRIOR_ROWS = 20
PLACE_BITS = 30      # of a window's place in its text; more words than that exceed what a string can hold


def _matching(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measure(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper and base_failed.

    Repeated 3-word windows are found by sorting (hash, position) packed into one number; windows whose hash bits
    meet are compared as text, so the count is exact. Every step is n log n in the words of one text. Write the result before
    using it twice or filtering it (``cut_lineage``): Spark would copy these expressions into what comes after.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    none = F.array().cast("array<string>")
    split = docs.withColumns({
        "_words": F.when(trimmed == "", none).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+")),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")),
        "n_symbols": _matching(t, r"[#*$%&|<>]+").cast("long"),
        "n_upper": _matching(t, r"[A-Z]+").cast("long")})
    n = F.size("_words")
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")
    packed = F.transform(
        F.slice("_words", 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    counted = split.withColumns({
        "n_words": n.cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.sort_array(packed)})
    same = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
    met = counted.withColumn("_met", F.filter("_hashes", lambda x, j: F.coalesce(
        F.when(j > 0, same(F.get("_hashes", j - 1), x)), F.lit(False)) | F.coalesce(same(F.get("_hashes", j + 1), x), F.lit(False))))
    window = lambda p: F.concat_ws(" ", F.get("_words", p), F.get("_words", p + 1), F.get("_words", p + 2))
    texts = met.withColumn("_found", F.array_sort(F.transform("_met", lambda x: F.struct(
        window(x.bitwiseAND(low).cast("int")).alias("w"), x.bitwiseAND(low).cast("int").alias("p")))))
    again = F.filter("_found", lambda x, j: F.coalesce(F.when(j > 0, F.get("_found", j - 1)["w"] == x["w"]), F.lit(False))
                     | F.coalesce(F.get("_found", j + 1)["w"] == x["w"], F.lit(False)))
    places = F.sort_array(F.transform(again, lambda x: x["p"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    out = texts.withColumn("n_repeat_words", covered).drop("_words", "_lines", "_hashes", "_met", "_found")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def metrics() -> dict[str, Column]:
    share = lambda a, b: (F.col(a) + 1).cast("double") / (F.col(b) + 1).cast("double")
    return {"word_length": F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double")),
            "symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars")}


def bucket(value: Column, alpha: float) -> Column:
    """Bucket i holds the values in (g^(i-1), g^i]."""
    return F.ceil(F.log(value) / F.lit(math.log((1 + alpha) / (1 - alpha))))


def sketches(measured: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(lang, source, metric, bucket, n) of the rows that did not fail the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v, alpha).alias("b")) for k, v in metrics().items()])).alias("m")
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", each)
    return rows.groupBy("lang", "source", F.col("m.metric").alias("metric"), F.col("m.b").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q1, q3 (as buckets) and the rows of every sketch, merged over all columns but ``keys``."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*keys, "metric")
    seen = merged.select(*keys, "metric", "bucket", F.sum("n").over(whole.orderBy("bucket")).alias("upto"), F.sum("n").over(whole).alias("rows"))
    at = lambda q: F.min(F.when(F.col("upto") > q * (F.col("rows") - 1), F.col("bucket"))).cast("double")
    return seen.groupBy(*keys, "metric").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("rows").alias("rows"))


def limits(sketch: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, low_word_length, high_<metric> ...) in buckets, one row for every group of the sketches."""
    by_source = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(sketch, ["lang"]).toDF("l_lang", "metric", "l_q1", "l_q3", "l_rows")
    by_all = quartiles(sketch, []).toDF("metric", "a_q1", "a_q3", "a_rows")
    both = (by_source.join(by_lang, (by_source["lang"].eqNullSafe(by_lang["l_lang"])) & (by_source["metric"] == by_lang["metric"]))
            .drop(by_lang["metric"]).join(by_all, "metric"))
    mix = lambda own, rows, wider: (own * rows + wider * prior_rows) / (rows + prior_rows)
    pick = lambda q: mix(F.col(q), F.col("rows"), mix(F.col(f"l_{q}"), F.col("l_rows"), F.col(f"a_{q}")))
    out = both.select("lang", "source", "metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    spread = FENCE * (F.col("q3") - F.col("q1"))
    here = lambda m, v: F.max(F.when(F.col("metric") == m, F.round(v, 6)))
    return out.groupBy("lang", "source").agg(
        here("word_length", F.col("q1") - spread - 1).alias("low_word_length"), *[here(m, F.col("q3") + spread + 1).alias(f"high_{m}") for m in METRICS])


def judge(measured: DataFrame, prior_rows: int = PRIOR_ROWS, alpha: float = 0.01) -> DataFrame:
    """Add ``kept`` to measured rows, and ``why``: the metrics outside their limits."""
    found = cut_lineage(limits(sketches(measured, alpha), prior_rows)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(found, measured["lang"].eqNullSafe(found["_lang"]) & measured["source"].eqNullSafe(found["_source"]), "left")
    at = {m: bucket(v, alpha) for m, v in metrics().items()}
    outside = [F.when((at[m] > F.col(f"high_{m}")) & (F.col(c) > 0) | (F.lit(m == "word_length") & (at[m] < F.col("low_word_length"))), F.lit(m))
               for m, c in METRICS.items()]
    return (joined.withColumn("why", F.array_compact(F.array(*outside)))
            .withColumn("kept", ~F.col("base_failed") & (F.size("why") == 0))
            .drop("_lang", "_source", "low_word_length", *[f"high_{m}" for m in METRICS]))


def quality_table(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document, without the texts."""
    return judge(cut_lineage(measure(docs.select("doc_id", "lang", "source", "text")).drop("text")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns and nothing else."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text", "lang", "source")
    return judge(cut_lineage(measure(packed).drop("text"))).filter("kept").select("_doc.*")
