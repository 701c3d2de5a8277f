"""Answer rules I1-I13 on table-driven golden cases (FIXTURES.md) and quirks."""

import math

import pytest
from pyspark.sql import functions as F

from mathtide.functions import answers as A
from mathtide.operators.shape import EIGHT_SHOT_PROMPT

GOLDEN = [  # text, I1, I3, I4 (V2)
    ("... #### 18", 18.0, 18.0, 18.0),
    ("#### $1,200", 1200.0, 1.0, 200.0),
    ("1 #### 2 #### 3 4", 3.0, 3.0, 4.0),
    ("5 #### none", 5.0, 5.0, 5.0),
    ("7 8<|endoftext|>no", 7.0, 8.0, 8.0),
    ("5-3", -3.0, -3.0, 3.0),
    ("The answer is 6. Then 9", 9.0, 9.0, 6.0),
    ("The answer is $5", 5.0, 5.0, 5.0),
    ("none", None, None, None),
]


def _eval(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_golden_extractors(spark):
    texts = [g[0] for g in GOLDEN]
    assert _eval(spark, texts, A.extract_answer) == [g[1] for g in GOLDEN]
    assert _eval(spark, texts, A.extract_answer_plain) == [g[2] for g in GOLDEN]
    assert _eval(spark, texts, A.extract_predicted_answer) == [g[3] for g in GOLDEN]


def test_eight_shot_examples(spark):
    answers = [line[3:] for line in EIGHT_SHOT_PROMPT.split("\n") if line.startswith("A: ")]
    assert _eval(spark, answers, A.extract_predicted_answer) == [6, 5, 39, 8, 9, 29, 33, 8]


def test_ground_truth_has_no_fallback(spark):
    assert _eval(spark, ["#### 12", "The answer is 7."], A.extract_ground_truth) == [None, 7.0]


def test_v1_predicted_has_no_fallback(spark):
    out = _eval(spark, ["no marker 4"], lambda c: A.extract_predicted_answer(c, fallback=False))
    assert out == [None]


def test_cleaning_quirks(spark):
    got = _eval(spark, ["5 months", "3 mph", "$1,000 dollars", "20%"], A.clean_number_text)
    assert got == ["5onths", "3ph", "1000", "20"]


def test_end_marker_and_eos(spark):
    got = _eval(spark, ["a 3 <|endoftext|> b 4 <|endoftext|>"], A.extract_answer)
    assert got == [4.0]
    got = _eval(spark, ["x 1 </s> #### 9"], lambda c: A.extract_answer(c, eos="</s>"))
    assert got == [1.0]


def test_keyword_answer(spark):
    got = _eval(spark, ["The TOTAL = 42 apples", "so 17 is the answer", "nothing here"],
                A.extract_keyword_answer)
    assert got == ["42", "17", "nothing here"]


def test_to_number(spark):
    df = spark.createDataFrame([("6.",), ("1_000",), (" 2.5 ",), ("abc",), ("inf",), ("1e3",)], "s string")
    rows = df.select(A.to_number("s").alias("n")).collect()
    vals = [(r.n.value, r.n.is_whole) for r in rows]
    assert vals[0] == (6.0, True)
    assert vals[1] == (1000.0, True)
    assert vals[2] == (2.5, False)
    assert vals[3] == (None, False)
    assert math.isinf(vals[4][0]) and vals[4][1] is False
    assert vals[5] == (1000.0, True)


@pytest.mark.parametrize("p,g,expected", [
    (None, 1.0, False), (3.0, 3.0, True), (3.0, 4.0, False), (1.005, 1.0, True),
    (1.02, 1.0, False), (0.5, 0.0, False)])
def test_is_correct(spark, p, g, expected):
    df = spark.createDataFrame([(p, g)], "p double, g double")
    assert df.select(A.is_correct("p", "g")).first()[0] is expected


def test_closeness_and_exact(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, 2.0)], "p double, g double")
    rows = df.select(A.closeness("p", "g"), A.is_exact("p", "g")).collect()
    assert [tuple(r) for r in rows] == [("correct", True), ("incorrect", False), ("no_answer", False)]


def test_post_process_and_cuts(spark):
    got = _eval(spark, ["work #### 5\n\nmore #### 6", "plain"], A.post_process_response)
    assert got == ["work #### 5", "plain"]
    got = _eval(spark, ["Q: a\nA: b\nA: 12 Q: c", "no marker"], A.completion_after_last_a)
    assert got == ["12", ""]
    got = _eval(spark, ["answer 4</s>junk", "x<|im_end|>Q:"], A.cut_at_stop)
    assert got == ["answer 4", "x"]


def test_completion_text(spark):
    df = spark.createDataFrame([("PROMPT text out ", "PROMPT", "gpt2"),
                                ("Q Answer: a Answer:  7 ", "Q", "qwen")], "r string, p string, k string")
    got = [r[0] for r in df.select(A.completion_text("r", "p", F.col("k"))).collect()]
    assert got == ["text out", "7"]


def test_answer_rules_stay_in_jvm(spark):
    df = spark.createDataFrame([("#### 3",)], "t string")
    plan = df.select(A.extract_answer("t"), A.extract_predicted_answer("t"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
