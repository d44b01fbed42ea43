"""Adaptive quality rules: per-language and per-source fences from sketches.

Every document gets integer metrics in one pass of built-in functions.  Their
distribution per (language, source) is kept in a log-linear histogram: a value
loses all but its ``BITS`` highest bits, so a quantile is off by under
2**-(BITS-1) of its value.  Histograms merge by adding counts, so small groups
fall back to the merged histogram of their language and then of all documents.
A document is kept if each metric lies within the fences of its group,
``q90 + REACH * (q90 - q50)`` above and ``q10 - REACH * (q50 - q10)`` below.
Both come from the group's own distribution; a spread narrower than a bucket
counts as one bucket, as the sketch can't tell it from that.  A document over
a fence only by a single event (one line, one symbol) is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm._spark import materialize

SPACES = r"[\x20\x09-\x0D]+"
#: Highest bits that a histogram bucket keeps.
BITS = 6
#: Metric -> (numerator, denominator, scale, numerator of a single event, has a lower fence).
METRICS = {
    "symbols": ("n_symbols", "word_chars", 10_000, 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 1, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, 6, False),
    "word_length": ("word_chars", "n_words", 100, 0, True),
    "capitals": ("n_capitals", "word_chars", 10_000, 1, False),
}
#: Multiples of the spread between a tail quantile and its fence.
REACH = 6
#: Tenths of the documents below each quantile that is read off a sketch.
QUANTILES = {"q10": 1, "q50": 5, "q90": 9}
#: Documents below which a group uses the next wider histogram.
LEAST_DOCS = 200


def _repeat_words(words: Column, grams: Column) -> Column:
    """Words in three-word windows that occur twice or more."""
    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = F.transform(
        F.arrays_zip(ordered.alias("a"), F.slice(ordered, 2, F.size(ordered)).alias("b")),
        lambda p: F.when(p["a"]["h"] == p["b"]["h"], F.array(p["a"]["i"], p["b"]["i"])),
    )
    starts = F.array_distinct(F.flatten(F.filter(marked, lambda p: p.isNotNull())))
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def document_metrics(docs: DataFrame, carry: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, ``carry`` and the counts of each whole text; no shuffle.

    Null and empty texts have no words, lines with words or symbols: all zero.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", *carry, text.alias("text"))
    split = base.withColumn("words", F.array_remove(F.split("text", SPACES), "")).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    counted = split.select(
        "doc_id",
        *carry,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    words = F.col("words")
    grams = counted.withColumn(
        "grams",
        F.when(
            F.col("n_words") > 3,
            F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        ),
    )
    g = F.col("grams")
    repeated = F.when(g.isNull() | (F.size(F.array_distinct(g)) == F.size(g)), 0).otherwise(_repeat_words(words, g))
    return grams.select("doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"), "n_lines", "n_capitals")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metric(name: str, without_event: bool = False) -> Column:
    top, below, scale, event, _ = METRICS[name]
    return F.expr(f"({scale} * greatest({top} - {event if without_event else 0}, 0)) div greatest({below}, 1)")


def _shift(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))


def bucket(value: Column) -> Column:
    """Lower edge of the value's bucket."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, _shift(value)), _shift(value))


def bucket_width(value: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), _shift(value))


def sketch(stats: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Histogram rows (keys, metric, bucket, n) of the documents that pass the base rules."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(metric(m)).alias("bucket")) for m in METRICS))
    long = stats.where(~base_failed()).select(*keys, F.explode(pairs).alias("p"))
    return long.groupBy(*keys, F.col("p.metric").alias("metric"), F.col("p.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the histogram down to ``keys`` and read n and ``QUANTILES`` of each metric."""
    merged = histogram.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*keys, "metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = merged.withColumn("below", F.sum("n").over(up))
    total = merged.groupBy(*keys, "metric").agg(F.sum("n").alias("total"))
    same = [summed[k].eqNullSafe(total[k]) for k in [*keys, "metric"]]
    joined = summed.join(total, on=same).select(*(summed[k] for k in [*keys, "metric"]), "bucket", "below", "total")
    return joined.groupBy(*keys, "metric").agg(
        F.first("total").alias("n"), *(F.min(F.when(10 * F.col("below") >= tenths * F.col("total"), F.col("bucket"))).alias(q) for q, tenths in QUANTILES.items())
    )


def fences(histogram: DataFrame, least_docs: int = LEAST_DOCS, reach: int = REACH) -> DataFrame:
    """One row per (lang, source): lower and upper fence of each metric.

    A group under ``least_docs`` documents takes its language's fences, a
    language under it those of all documents.
    """
    own, wide, whole = (quantiles(histogram, k) for k in (["lang", "source"], ["lang"], []))
    wide = wide.select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), F.col("n").alias("l_n"), *(F.col(q).alias(f"l_{q}") for q in QUANTILES))
    whole = whole.select(F.col("metric").alias("a_metric"), *(F.col(q).alias(f"a_{q}") for q in QUANTILES))
    all_levels = own.join(wide, own["lang"].eqNullSafe(wide["l_lang"]) & (own["metric"] == wide["l_metric"])).join(whole, own["metric"] == whole["a_metric"])
    pick = lambda q: F.when(F.col("n") >= least_docs, F.col(q)).when(F.col("l_n") >= least_docs, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    chosen = all_levels.select("lang", "source", "metric", *(pick(q).alias(q) for q in QUANTILES))
    spread = lambda a, b, at: F.greatest(F.col(a) - F.col(b), bucket_width(F.col(at)))
    columns = []
    for m, (*_, low) in METRICS.items():
        columns.append(F.max(F.when(F.col("metric") == m, F.col("q90") + reach * spread("q90", "q50", "q90"))).alias(f"hi_{m}"))
        if low:
            columns.append(F.max(F.when(F.col("metric") == m, F.col("q10") - reach * spread("q50", "q10", "q10"))).alias(f"lo_{m}"))
    return chosen.groupBy("lang", "source").agg(*columns)


def quality_rules(docs: DataFrame, least_docs: int = LEAST_DOCS, reach: int = REACH) -> DataFrame:
    """Per document: doc_id, the counts, base_failed and kept.

    ``docs`` needs doc_id, text, lang and source; other columns are ignored.
    Null languages and sources are groups of their own.  Repeated rows each get
    a row.  A null or empty text has no words and fails the base rules.  An
    empty table gives an empty result.  Metrics are computed once and written
    to the shared folder, as both the sketch and the verdict read them.
    """
    stats = materialize(document_metrics(docs), "quality-metrics")
    limits = fences(sketch(stats), least_docs, reach)
    limits = limits.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = stats.join(limits, stats["lang"].eqNullSafe(limits["f_lang"]) & stats["source"].eqNullSafe(limits["f_source"]), "left")
    inside = F.lit(True)
    for m, (*_, low) in METRICS.items():
        inside &= metric(m, without_event=True) <= F.col(f"hi_{m}")
        if low:
            inside &= metric(m) >= F.col(f"lo_{m}")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"), "n_lines", "n_capitals",
    )
