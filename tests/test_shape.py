"""Renderers, standardisers (incl. quirks Q1-Q3) and prompts."""

from pyspark.sql import functions as F

from mathtide.operators import shape as B
from mathtide.plans import curriculum as C


def _one(spark, expr_fn, row, schema):
    return spark.createDataFrame([row], schema).select(expr_fn().alias("x")).first().x


def test_render_asdiv_cases(spark):
    schema = "b string, q string, a string, f string"
    cases = [((" B ", " Q? ", " 3 ", "1+2"), "Question: B Q?\nSolution: 1+2\nAnswer: 3"),
             (("", "Q?", "3", "1+2"), "Question: Q?\nSolution: 1+2\nAnswer: 3"),
             (("B", "Q?", "3", ""), "Question: B Q?\nAnswer: 3"),
             ((None, "Q?", "3", None), "Question: Q?\nAnswer: 3")]
    for row, expected in cases:
        assert _one(spark, lambda: B.render_asdiv("b", "q", "a", "f"), row, schema) == expected


def test_render_aqua(spark):
    row = ("Q", ["1", "2"], " R ", "B")
    got = _one(spark, lambda: B.render_aqua("q", "o", "r", "c"), row,
               "q string, o array<string>, r string, c string")
    assert got == "Question: Q\nOptions:\nA. 1\nB. 2\nRationale: R\nAnswer: B"


def test_standardise_and_drop(spark):
    df = spark.createDataFrame([("Question: Q?\nSolution: s\nAnswer: 3",),
                                ("Question: Q?\nAnswer: 3",),                  # Q1: dropped
                                ("Question: A Question: B\nSolution: s\nAnswer: 3",)],  # Q2
                               "t string")
    rows = df.select(B.standardise(F.col("t"), "Solution").alias("s")).collect()
    assert rows[0].s.question == "Q?"
    assert rows[0].s.answer == "Let me solve this step by step.\ns\nTherefore, the answer is 3."
    assert rows[1].s is None
    assert rows[2].s is None     # only the piece before the second 'Question: ' is kept


def test_standardise_aqua_first_answer(spark):
    t = "Question: Q\nOptions:\nA. 1\nRationale: so Answer: 9\nAnswer: A"
    df = spark.createDataFrame([(t,)], "t string")
    first = df.select(B.standardise_aqua(F.col("t")).alias("s")).first().s
    last = df.select(B.standardise_aqua(F.col("t"), last_answer=True).alias("s")).first().s
    assert first.question == "Q\nOptions:\nA. 1"
    assert first.answer.endswith("the answer is 9.")      # Q3
    assert last.answer.endswith("the answer is A.")


def test_prompts_and_attach(spark):
    shots = spark.createDataFrame([(1, "q1", "a1", 1), (0, "q0", "a0", 0)],
                                  "id int, question string, answer string, r int")
    block = B.few_shot_block(shots, "r")
    assert block.first().shots == "Question: q0\nAnswer: a0\n\nQuestion: q1\nAnswer: a1\n\n"
    test = spark.createDataFrame([("T",)], "question string")
    out = B.attach_shots(test, block)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert out.first().prompt.startswith("Question: q0\n") and "Question: T\n" in out.first().prompt
    assert B.eval_prompt(F.lit("x"), "eight_shot") is not None


def test_chat_prompt(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", "yo")],
                                  "conv_id long, turn long, role string, text string")
    r = B.chat_prompt(turns).first()
    assert r.prompt == ("<|im_start|>user\nyo<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
                        "<|im_start|>assistant\n")


def test_require_columns(spark):
    import pytest
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(KeyError, match="Available columns"):
        B.require_columns(df, "text")


def test_curriculum_cap(spark):
    rendered = spark.createDataFrame(
        [("AQuA", 5, i, f"Question: q{i}\nOptions:\nA. 1\nRationale: r\nAnswer: A") for i in range(30)],
        "dataset string, stage int, row_key long, text string")
    out = C.prepare(rendered, caps={"AQuA": 12})
    assert out.count() == 12
    assert sorted(r.row_key for r in out.collect()) == list(range(12))
    assert out.where(F.col("split") == "test").count() == 2


def test_drop_unparseable_counts(spark):
    from mathtide.operators.filters import drop_unparseable
    rendered = spark.createDataFrame(
        [("SVAMP", 3, 1, "Question: q\nEquation: e\nAnswer: 1"), ("SVAMP", 3, 2, "Question: q\nAnswer: 1")],
        "dataset string, stage int, row_key long, text string")
    kept, counts = drop_unparseable(C.standardised(rendered), "question")
    assert kept.count() == 1
    assert counts.first().asDict() == {"seen": 2, "dropped": 1}
    assert C.prepare(rendered, caps={}).count() == 1


def test_map_rows_and_batches(spark):
    from mathtide.operators import udf as U
    df = spark.range(0, 10)
    rows = U.map_rows(df, lambda r: {"id": r["id"], "sq": r["id"] ** 2}, "id long, sq long").collect()
    assert sorted(r.sq for r in rows) == [i * i for i in range(10)]
    sizes = U.map_batches(df.repartition(1), lambda pdf: pdf.assign(n=len(pdf)), "id long, n long", 4).collect()
    assert sorted({r.n for r in sizes}) == [2, 4]
