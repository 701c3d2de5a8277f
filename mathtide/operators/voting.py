"""Votes, gold pairing and accuracy.

Every aggregate here is decomposable, so Spark runs a partial aggregate before
each shuffle: a question (or run) holding a third of all votes is reduced on
the map side to one row per (question, answer) per task before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathtide.operators.ranking import running_totals


def _cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


_SHIFT = "1" + "0" * 28          # 10^28: count and first position share one decimal key
_DEC = "decimal(38,0)"


def _packable(dtype: T.DataType) -> bool:
    """Integral positions, or decimal positions of at most 27 digits."""
    if isinstance(dtype, T.DecimalType):
        return dtype.scale == 0 and dtype.precision <= 27
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def majority_vote(votes: DataFrame, question: str | Sequence[str], answer: str,
                  order: str | Column, out: str = "majority_answer") -> DataFrame:
    """Most common non-null answer per question; tie -> seen first.

    ``order`` is the vote position.  Two decomposable aggregates: per
    (question, answer) the count and first position, then per question the
    answer with the largest count and earliest first position.  When the
    position is an integer (or a decimal of at most 27 digits) that choice is
    one ``min_by`` over a packed decimal key (-count * 10^28 + first), so both
    levels run as hash aggregates with map-side partial aggregation; any other
    orderable position (e.g. a struct) uses a struct key.  Questions whose
    votes are all null keep a row with a null majority.  Output: question
    keys, ``n_votes``, ``n_answered``, ``majority_votes`` and ``out``.
    """
    q = _cols(question)
    order_col = F.col(order) if isinstance(order, str) else order
    data = votes.select(*q, F.col(answer).alias("__a"), order_col.alias("__o"))
    packed = _packable(data.schema["__o"].dataType)
    if packed:
        data = data.withColumn("__o", F.col("__o").cast(_DEC))
    per_answer = (data.groupBy(*q, "__a")
                  .agg(F.count(F.lit(1)).alias("__c"), F.min("__o").alias("__first")))
    if packed:
        key = (-(F.col("__c").cast(_DEC)) * F.lit(_SHIFT).cast(_DEC)).cast(_DEC) + F.col("__first")
        ranked = F.when(F.col("__a").isNotNull(), key.cast(_DEC))
    else:
        ranked = F.when(F.col("__a").isNotNull(),
                        F.struct((-F.col("__c")).alias("c"), F.col("__first").alias("f")))
    return (per_answer.groupBy(*q)
            .agg(F.sum("__c").alias("n_votes"),
                 F.sum(F.when(F.col("__a").isNotNull(), F.col("__c")).otherwise(0)).alias("n_answered"),
                 F.min_by("__a", ranked).alias(out),
                 F.max(F.when(F.col("__a").isNotNull(), F.col("__c"))).alias("majority_votes")))


def first_vote(votes: DataFrame, question: str | Sequence[str], answer: str,
               order: str, out: str = "majority_answer") -> DataFrame:
    """The answer of each question's first vote (method 'none'), one partial
    aggregate: ``min_by`` over the vote position (packed when integral)."""
    q = _cols(question)
    data = votes.select(*q, F.col(answer).alias("__a"), F.col(order).alias("__o"))
    if _packable(data.schema["__o"].dataType):
        data = data.withColumn("__o", F.col("__o").cast(_DEC))
    return data.groupBy(*q).agg(
        F.lit(1).cast("long").alias("n_votes"),
        F.min_by(F.col("__a").isNotNull().cast("long"), "__o").alias("n_answered"),
        F.min_by("__a", "__o").alias(out),
        F.lit(1).cast("long").alias("majority_votes"))


def pair_with_gold(results: DataFrame, gold: DataFrame, question: str | Sequence[str],
                   how: str = "inner") -> DataFrame:
    """D3: each result next to the gold answer of its question (equi-join).

    ``how='right'`` keeps unanswered gold questions (they count as wrong).
    """
    return results.join(gold, on=_cols(question), how=how)


def accuracy(df: DataFrame, correct: str, group_by: str | Sequence[str] = ()) -> DataFrame:
    """Correct / total per group; missing verdicts count as wrong; null on 0 rows."""
    g = _cols(group_by) if group_by else []
    ok = F.coalesce(F.col(correct).cast("boolean"), F.lit(False))
    agg = [F.count(F.lit(1)).alias("n_total"),
           F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("n_correct")]
    grouped = df.groupBy(*g).agg(*agg)
    return grouped.withColumn(
        "accuracy", F.when(F.col("n_total") > 0, F.col("n_correct") / F.col("n_total")))


def collect_votes(votes: DataFrame, question: str | Sequence[str], order: str,
                  fields: Sequence[str], chunk_size: int = 1000) -> DataFrame:
    """Per question, arrays of each field in vote order.

    The arrays are the result record of a majority-vote evaluation.  A
    question's votes are cut into records of at most ``chunk_size`` votes
    (``chunk`` = position // chunk_size, positions from the skew-safe ranking),
    so even a question holding a third of all votes never forms one array.
    """
    q = _cols(question)
    data = running_totals(votes, order_by=[order], partition_by=q, rank_col="__pos") \
        .withColumn("chunk", F.floor(F.col("__pos") / F.lit(chunk_size))).drop("__pos")
    keys = q + ["chunk"]
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"),
                                                  *[F.col(f) for f in fields])))
    out = data.groupBy(*keys).agg(packed.alias("__votes"))

    def field(name):
        return F.transform("__votes", lambda x: x[name]).alias(f"{name}s")
    return out.select(*keys, *[field(f) for f in fields])


def running_accuracy(examples: DataFrame, correct: str, order_by: Sequence[str],
                     run: str | Sequence[str] = ()) -> DataFrame:
    """F1 + F3: after each example, correct so far / examples so far.

    Adds ``example_idx`` (0-based) and ``running_accuracy``; exact and skew-safe
    through ``running_totals`` (no one-task window over a whole run).
    """
    data = examples.withColumn("__ok", F.coalesce(F.col(correct).cast("boolean"), F.lit(False)).cast("long"))
    out = running_totals(data, order_by=list(order_by), partition_by=_cols(run) if run else [],
                         sums=["__ok"], rank_col="example_idx", sum_prefix="running_correct")
    out = out.withColumnRenamed("running_correct__ok", "running_correct").drop("__ok")
    return out.withColumn("running_accuracy", F.col("running_correct") / (F.col("example_idx") + 1))
