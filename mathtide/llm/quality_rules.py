"""Quality rules with adaptive thresholds.

Statistics of every whole text come from built-in functions only.  Fixed
cut-offs give ``base_failed``.  The method's own verdict replaces further fixed
cut-offs by thresholds that adapt to each (lang, source): KLL quantile sketches
of four ratios are built per (lang, source) with map-side partial sketches,
merged per language, and joined back; a document is rejected if a ratio lies
above its upper fence, the third quartile plus FENCE interquartile ranges (the
interquartile range is at least FLOOR, which keeps groups without any spread
from rejecting the first document that differs).  A group of fewer than
LEAST_ROWS documents uses its language's fences.

Words in 8-word windows found twice or more: windows are compared by their
64-bit xxhash within one text.

Nulls: a null text has no words (base_failed); a null lang or source is a group
of its own; null doc_ids are carried.  Empty texts fail by n_words < 20.
Repeated rows each get a row.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import BLANKS, keep, text_or_empty, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_ROWS = 200
FENCE = 3.0
#: least interquartile range of each ratio
FLOOR = {"symbols": 0.05, "repeats": 0.1, "dup_lines": 0.12, "word_length": 1.0, "shouting": 0.08}


def _windows(w: Column) -> Column:
    """xxhash64 of every window of WINDOW words."""
    return F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))


def _covered(h: Column) -> Column:
    """Words covered by windows whose hash occurs again in ``h``."""
    sorted_h = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        def again(x, k):
            return ((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(again(x, k), F.lit(False))),
                                        lambda x: x["i"]))

    # binds the sorted array and the places once: transform over a one-element array
    spans = F.transform(F.transform(F.array(sorted_h), places), lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x))
    return F.element_at(spans, 1)


def statistics(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and the counts of every text."""
    text = F.col("__text")
    rows = docs.select(*columns, text_or_empty().alias("__text")).withColumn("__w", words(text))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    rows = rows.select(
        *columns,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_shouts"),
        lines.alias("__lines"), _windows(F.col("__w")).alias("__h"))
    repeated = F.size("__h") > F.size(F.array_distinct("__h"))
    return rows.select(
        *columns, "n_words", "word_chars", "n_symbols", "n_shouts",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("__h"))).otherwise(0).cast("long").alias("n_repeat_words"))


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbols": F.col("n_symbols") / n, "repeats": F.col("n_repeat_words") / n,
            "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "word_length": F.col("word_chars") / n, "shouting": F.col("n_shouts") / n}


def fences(stats: DataFrame, fence: float = FENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, fence_<ratio>...): the upper fences of every group."""
    names = list(_ratios())
    ratios = stats.where("not base_failed").select("lang", "source", *[c.alias(k) for k, c in _ratios().items()])
    groups = ratios.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(k).alias(f"s_{k}") for k in names])
    languages = groups.groupBy("lang").agg(*[F.kll_merge_agg_double(f"s_{k}").alias(f"m_{k}") for k in names])
    both = groups.join(languages.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")))

    def upper(k):
        s = F.when(F.col("n") >= least_rows, F.col(f"s_{k}")).otherwise(F.col(f"m_{k}"))
        q1, q3 = F.kll_sketch_get_quantile_double(s, F.lit(0.25)), F.kll_sketch_get_quantile_double(s, F.lit(0.75))
        return (q3 + fence * F.greatest(q3 - q1, F.lit(FLOOR[k]))).alias(f"fence_{k}")

    return both.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[upper(k) for k in names])


def judge(docs: DataFrame, fence: float = FENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The counts, base_failed and kept of every document."""
    stats = statistics(docs, ("doc_id", "lang", "source")).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    stats = keep(stats, "stats")
    limits = fences(stats, fence, least_rows)
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")),
                        "left")
    beyond = F.lit(False)
    for k, ratio in _ratios().items():
        beyond = beyond | F.coalesce(ratio > F.col(f"fence_{k}"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))
