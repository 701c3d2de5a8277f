"""Curriculum preparation (A14 union + K5 composite, E4 counts).

All five datasets are prepared in one plan with ``dataset`` and ``stage``
columns; only model training is sequential over stages, not the data work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.operators import sampling as S
from mathtide.operators import shape as B
from mathtide.operators.filters import drop_unparseable
from mathtide.session import checkpoint_dir

# Dataset names in curriculum order, and the formatter's
# solution key per dataset.
CURRICULUM = [
    ("ASDiv", 1, "Solution"),
    ("ParaMAWPS", 2, "Equation"),
    ("SVAMP", 3, "Equation"),
    ("DMath", 4, "Solution"),
    ("AQuA", 5, None),
]
STANDARD_COLUMNS = ["dataset", "stage", "row_key", "question", "answer"]


def standardised(rendered: DataFrame, keep_text: bool = False) -> DataFrame:
    """Rendered texts -> dataset, stage, row_key, question, answer (failed rows kept as null).

    Same rules as ``standardise`` / ``standardise_aqua``, computed in stages:
    each split is its own column, so a piece used by the null check and by the
    output is cut once per row.
    """
    from mathtide.functions.text import piece, py_strip
    d, t = F.col("dataset"), F.col("text")
    solution_sets = {key for _, _, key in CURRICULUM if key}
    key_of = F.lit(None).cast("string")
    for name, _, key in CURRICULUM:
        if key:
            key_of = F.when(d == name, F.lit(key)).otherwise(key_of)
    aqua = d == "AQuA"
    body = piece(t, "Question: ", 1)
    stage1 = rendered.withColumn("__key", key_of).withColumn("__body", body)
    parts = F.lit(None).cast("array<string>")
    for key in sorted(solution_sets):
        parts = F.when(F.col("__key") == key,
                       F.split(F.col("__body"), B.quote_regex(f"\n{key}:"))).otherwise(parts)
    stage2 = stage1.withColumn("__parts", parts)
    stage3 = stage2.withColumn("__sa", F.split(F.get(F.col("__parts"), 1), B.quote_regex("\nAnswer:")))
    q_part, solution, answer = F.get("__parts", 0), F.get("__sa", 0), F.get("__sa", 1)
    ok = q_part.isNotNull() & solution.isNotNull() & answer.isNotNull()
    generic = F.when(ok, F.struct(py_strip(q_part).alias("question"),
                                  B._solved(py_strip(solution), py_strip(answer)).alias("answer")))
    std = F.when(aqua, B.standardise_aqua(t)).otherwise(generic)
    out = stage3.withColumn("__std", std)
    return out.select("dataset", "stage", "row_key", *(["text"] if keep_text else []),
                      F.col("__std.question").alias("question"), F.col("__std.answer").alias("answer"))


def dataset_counts(rendered: DataFrame) -> DataFrame:
    """Raw and kept rows per dataset plus a total row (dataset null), Q6."""
    return standardised(rendered).rollup("dataset").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("question").isNotNull()).alias("n_kept"))


def prepare(rendered: DataFrame, caps: dict[str, int] | None = None, seed: int = 42,
            test_size: float = 0.1) -> DataFrame:
    """K5: standardise -> drop failures -> cap -> prompt -> seeded shuffle + split.

    ``caps`` maps a dataset to its first-n cap (the reference cuts AQuA at
    15000).  Rows whose formatter fails are dropped (C3); ``dataset_counts``
    reports raw and kept rows per dataset.  ``row_key`` must be unique in its
    dataset, as a position is.

    Cap, split and place are decided on (dataset, row_key) alone, which is
    checkpointed; the texts meet that decision in one join and are never
    checkpointed themselves.
    """
    caps = {"AQuA": 15000} if caps is None else caps
    std, _ = drop_unparseable(standardised(rendered), "question")
    checkpoint_dir(std.sparkSession)
    keys = std.select("dataset", "row_key").checkpoint()
    parts = [keys.where(~F.col("dataset").isin(*caps))] if caps else [keys]
    parts += [S.take(keys.where(F.col("dataset") == name), n, ["row_key"]) for name, n in caps.items()]
    decided = S.train_test_split(reduce(lambda a, b: a.unionByName(b), parts), test_size, seed,
                                 key="row_key", group="dataset")
    out = std.join(decided, ["dataset", "row_key"]).withColumn("prompt", B.sft_prompt("question", "answer"))
    return out.select(*STANDARD_COLUMNS, "prompt", "split", "shuffle_pos")


def render_problems(problems: DataFrame) -> DataFrame:
    """The five renderers over one problem table in a single scan.

    Each problem row is rendered in every dataset's format and exploded to
    (dataset, stage, row_key, text) -- a narrow step, no union of five scans.
    """
    p = problems
    rendered = F.array(
        F.struct(F.lit("ASDiv").alias("dataset"), F.lit(1).alias("stage"),
                 B.render_asdiv(p.body, p.question, p.answer, p.equation).alias("text")),
        F.struct(F.lit("ParaMAWPS").alias("dataset"), F.lit(2).alias("stage"),
                 B.render_paramawps(p.question, p.equation, p.answer).alias("text")),
        F.struct(F.lit("SVAMP").alias("dataset"), F.lit(3).alias("stage"),
                 B.render_svamp(p.body, p.question, p.equation, p.answer).alias("text")),
        F.struct(F.lit("DMath").alias("dataset"), F.lit(4).alias("stage"),
                 B.render_dmath(p.question, p.equation, p.answer).alias("text")),
        F.struct(F.lit("AQuA").alias("dataset"), F.lit(5).alias("stage"),
                 B.render_aqua(p.question, p.options, p.rationale, p.correct).alias("text")))
    return p.select(F.col("pid").alias("row_key"), F.inline(rendered))
