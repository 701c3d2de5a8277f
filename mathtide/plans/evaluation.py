"""Response evaluation composite (K4): cut -> extract -> vote -> compare -> accuracy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mathtide.functions import answers as A
from mathtide.operators.ranking import input_slices
from mathtide.operators.voting import (accuracy, first_vote, majority_vote, pair_with_gold,
                                       running_accuracy)

# slices of votes for every SLICE_BYTES of compressed input, and slices that one question's votes may take
SLICES_PER_INPUT, SALTS = 16, 64

METHODS = ("none", "maj@8", "maj@k", "all")


def votes_for_method(votes: DataFrame, question: Sequence[str], order: str,
                     method: str = "all", n_votes: int = 8) -> DataFrame:
    """Keep the votes a method looks at.

    'none' keeps the first vote per question, 'maj@8' the first 8, 'maj@k' the
    first ``n_votes``; 'all' keeps every vote.  Votes are hashed into slices of a bounded
    size, a question's into up to SALTS of them; each keeps its k first, and only those
    meet in the question's slice, so neither step's sort grows with the input or with a
    question that holds many votes.  Null keys are questions like others.  ``evaluate``
    answers 'none' with one aggregate instead (``first_vote``).
    """
    if method not in METHODS:
        raise ValueError(f"unknown majority method {method!r}; expected one of {METHODS}")
    if method == "all":
        return votes
    k = 1 if method == "none" else 8 if method == "maj@8" else int(n_votes)
    slices = max(SLICES_PER_INPUT * input_slices(votes, 1), votes.sparkSession.sparkContext.defaultParallelism)
    votes = votes.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
    for keys in ([*question, "__salt"], list(question)):
        first = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())
        votes = votes.repartition(slices, *keys).withColumn("__vote_rank", F.row_number().over(first)) \
            .where(F.col("__vote_rank") <= k).drop("__vote_rank")
    return votes.drop("__salt")


def evaluate(responses: DataFrame, gold: DataFrame, question: str = "question_id",
             run: str | None = "run", response: str = "response", vote: str = "vote",
             gold_text: str = "answer",
             extractor: Callable[[Column], Column] = A.extract_answer,
             gold_extractor: Callable[[Column], Column] = A.extract_answer,
             method: str = "all", n_votes: int = 8,
             cut: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per (run, question): votes, majority answer, gold answer and verdicts.

    ``cut`` optionally turns a decoded response into the completion (I12/I13)
    before extraction.  Questions that a run left unanswered have no row here;
    ``accuracy_by_run`` counts them as wrong when it is given the gold table.
    """
    keys = ([run] if run else []) + [question]
    if cut is not None:
        # its own projection: the optimizer keeps an expensive column computed
        # once instead of inlining it into every use
        responses = responses.withColumn("__completion", cut(F.col(response)))
        response = "__completion"
    text = F.col(response)
    # extract first: only (keys, position, number) travel through any shuffle
    votes = responses.select(*keys, vote, extractor(text).alias("numeric"))
    if method == "none":
        maj = first_vote(votes, keys, "numeric", vote)
    else:
        maj = majority_vote(votes_for_method(votes, keys, vote, method, n_votes), keys, "numeric", vote)
    g = gold.select(question, gold_extractor(F.col(gold_text)).alias("gold_answer"))
    paired = pair_with_gold(maj, g, question, how="left")
    return paired.select(
        *keys, "n_votes", "n_answered", "majority_answer", "gold_answer",
        A.is_correct("majority_answer", "gold_answer").alias("correct"),
        A.is_exact("majority_answer", "gold_answer").alias("exact"),
        A.closeness("majority_answer", "gold_answer").alias("closeness"))


def accuracy_by_run(results: DataFrame, run: str | None = "run", correct: str = "correct",
                    gold: DataFrame | None = None) -> DataFrame:
    """E3 per run.  With ``gold`` (one row per question) the denominator is all
    gold questions, so a question without a response counts as wrong; without
    it, the questions answered."""
    out = accuracy(results, correct, [run] if run else [])
    if gold is None:
        return out
    total = gold.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = out.withColumn("n_total", total)
    return out.withColumn("accuracy", F.when(F.col("n_total") > 0, F.col("n_correct") / F.col("n_total")))


def running_accuracy_by_run(results: DataFrame, run: str = "run", question: str = "question_id",
                            correct: str = "correct") -> DataFrame:
    return running_accuracy(results, correct, order_by=[question], run=run)
