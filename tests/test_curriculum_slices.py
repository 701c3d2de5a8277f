"""The curriculum's cap and split are cut into slices by their rows, whatever the
reading of five files (a join each) made of the estimated size."""

from pyspark.sql import functions as F

from mathtide.operators import ranking
from mathtide.plans import curriculum as C
from mathtide.session import checkpoint_dir


def test_slices_of_the_curriculum(spark, monkeypatch):
    checkpoint_dir(spark)
    text = F.concat(F.lit("Question: q"), F.col("id").cast("string"), F.lit("\nSolution: s\nAnswer: 1"))
    df = spark.range(0, 40, numPartitions=2).select("id", F.lit("ASDiv").alias("dataset"), F.lit(1).alias("stage"),
                                                    F.col("id").alias("row_key"), text.alias("text"))
    for _ in range(4):
        df = df.hint("merge").join(spark.range(0, 40, numPartitions=2), "id").checkpoint()
    counts, plain = [], ranking.input_slices

    def recorded(*args):
        counts.append(plain(*args))
        return min(counts[-1], 8)
    monkeypatch.setattr(ranking, "input_slices", recorded)
    assert C.prepare(df.drop("id")).count() == 40
    assert counts and max(counts) <= 64


def test_formatter_runs_once_before_its_filter(spark):
    """Dropping what the formatter rejects does not compute its pieces anew in the filter."""
    from mathtide.operators.filters import drop_unparseable
    text = F.concat(F.lit("Question: q"), F.col("id").cast("string"), F.lit("\nSolution: s\nAnswer: 1"))
    rendered = spark.range(4).select(F.lit("ASDiv").alias("dataset"), F.lit(1).alias("stage"),
                                     F.col("id").alias("row_key"), text.alias("text"))
    kept, _ = drop_unparseable(C.standardised(rendered), "question")
    plan = kept.select("dataset", "row_key")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and not any("split(" in line for line in filters)
    assert kept.count() == 4 and kept.columns == C.STANDARD_COLUMNS


def test_sources_are_positioned_in_one_pass(spark, tmp_dir, monkeypatch):
    """Five sources cost one ranking, and positions start anew in each of them."""
    from mathtide.sources import readers as R
    passes, plain = [], R.global_rank

    def counted(*args, **kwargs):
        passes.append(args)
        return plain(*args, **kwargs)
    monkeypatch.setattr(R, "global_rank", counted)
    for name, rows in (("aqua", 7), ("dmath", 3)):
        if name == "aqua":
            spark.range(0, rows, numPartitions=2).select(
                F.concat(F.lit("q"), "id").alias("question"), F.array(F.lit("A)1")).alias("options"),
                F.lit("r").alias("rationale"), F.lit("A").alias("correct")).write.json(f"{tmp_dir}/aqua")
        else:
            spark.createDataFrame([('{"5": {"question_en": "a", "solution_code_en": "b", "answer_en": "1"}, '
                                    '"6": {"question_en": "c", "solution_code_en": "d", "answer_en": "2"}}',)],
                                  "value string").coalesce(1).write.text(f"{tmp_dir}/dmath")
    out = R.load_curriculum(spark, {"AQuA": f"{tmp_dir}/aqua", "DMath": f"{tmp_dir}/dmath"})
    got = {(r["dataset"], r["row_key"]): r["text"] for r in out.collect()}
    assert len(passes) == 1
    assert sorted(got) == [("AQuA", i) for i in range(7)] + [("DMath", i) for i in range(2)]
    assert all(f"q{i}" in got["AQuA", i] for i in range(7)) and "a" in got["DMath", 0] and "c" in got["DMath", 1]
