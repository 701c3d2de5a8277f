"""Mixing sources to target weights.

Every document gets a hash-random key; within each source the documents are
range-sorted by that key, distributed prefix sums of their sizes are taken
(narrow rows move once, ``running_totals``), and the mix is cut at the source's exact budget.  A budget above the source's
size repeats it: whole epochs first, then the head of one more epoch in the
same random order.

Nulls: a null text has size 0, a null source is a source of its own (last), a
null doc_id is hashed as the empty text.  Rows that are equal in all of these
are interchangeable and ordered by their place in the stored table.  An empty table gives an empty mix; a source without
words gets target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mathtide.llm.common import stored, text_or_empty, word_count
from mathtide.operators.ranking import running_totals

WEIGHTS = (3, 1, 2)      # by place of the source in code point order, repeating
SHARE = 1.5              # the mix's size as a share of all words
MOST = 2                 # times its own size that a source may give
SEED = 42


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Budgets of the sources in ``sizes`` (source, source_size), one row each.

    Water filling: sources in the order of cap / weight; a source is held at
    its cap while an equal share of what is left would exceed it, and the rest
    divide the remainder by weight.  The table has one row per source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("__ratio", "__place")
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("__place", (F.row_number().over(place) - 1).cast("long"))
              .withColumn("__w", w).withColumn("__cap", F.col("source_size") * float(most))
              .withColumn("__ratio", F.col("__cap") / F.col("__w"))
              .withColumn("__total", F.sum("source_size").over(all_rows) * share)
              .withColumn("__caps", F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("__rest", F.sum("__w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))))
    level = (F.col("__total") - F.coalesce(F.col("__caps"), F.lit(0.0))) / F.col("__rest")
    ranked = ranked.withColumn("__level", level)
    # the first source that the level does not fill sets the level of all later ones
    open_level = F.first(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("__open", open_level).select(
        "source", "source_size",
        F.when(F.col("__open").isNull() | (F.col("__ratio") < F.col("__open")), F.col("__cap"))
        .otherwise(F.col("__w") * F.col("__open")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken,
    and the columns of ``carry``.  ``taken`` counts the words that the mix takes
    of the document over all epochs; per source they sum to floor(target)."""
    rows = docs if {"__file", "__pos"} <= set(carry) else stored(docs)
    sized = rows.select("doc_id", *carry, "source", word_count(text_or_empty()).alias("size"),
                        # rows equal in all else still fall into different slices
                        F.xxhash64("__file", "__pos").alias("__place"),
                        F.when(F.col("source").isNull(), F.lit("n")).otherwise(
                            F.concat(F.lit("v"), F.col("source").cast("string"))).alias("__src"),
                        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
                                          ).cast("binary")).alias("__h"))
    placed = running_totals(sized, ["__h", "doc_id", "size", "__place"], ["__src"], ["size"], "__rank", "__upto_") \
        .withColumn("before_size", F.col("__upto_size") - F.col("size"))
    totals = placed.groupBy("__src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, most)
    targets = targets.select(F.when(F.col("source").isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("v"), F.col("source").cast("string"))).alias("__src"), "source_size", "target")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    head = budget - epochs * F.col("source_size")
    in_head = F.least(F.col("size"), F.greatest(F.lit(0), head - F.col("before_size")))
    return placed.join(targets, "__src").select(
        "doc_id", *carry, "size", "source", "source_size", "target",
        (F.col("size") * epochs + in_head).cast("long").alias("taken"))


def taken_documents(docs: DataFrame, mixed: DataFrame, key: list[str]) -> DataFrame:
    """The mix as documents: ``docs`` joined with ``mixed`` on ``key`` (which
    names a row), each repeated once per whole epoch, plus the part of one more
    epoch: whole, or for the one document at a source's cut its first words (its
n_chars, if there is such a column, follows).
    Documents without words take no budget and stay once."""
    words_taken = F.when(F.col("__size") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.filter(
        F.transform(F.sequence(F.lit(0), F.floor(F.col("__taken") / F.greatest(F.col("__size"), F.lit(1))).cast("int")),
                    lambda e: F.least(F.col("__size"), F.col("__taken") - e * F.col("__size"))), lambda n: n > 0))
    part = mixed.select(*key, F.col("size").alias("__size"), F.col("taken").alias("__taken")).where(
        (F.col("taken") > 0) | (F.col("size") == 0))
    rows = docs.join(part, key).withColumn("__n", F.explode(words_taken))
    # cut behind each word; the pieces keep their blanks
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("__n").cast("int")), "")
    cut = F.col("__n") < F.col("__size")
    rows = rows.withColumn("text", F.when(cut, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType))
                               .otherwise(F.col("n_chars")))
    return rows.drop("__n", "__size", "__taken")
