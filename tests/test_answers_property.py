"""Answer rules on random texts: Spark functions against the DuckDB restatement."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mathtide.functions import answers as A
from mathtide.plans import oracle as O

PIECES = ["1", "23", "4.5", ".7", "-", "+", "$", "€", ",", ".", " ", "\n", "####", "#",
          "<|endoftext|>", "kg", "mph", "dollars", "m", "s", "The answer is ", "answer is ",
          "total = ", "x", "A:", "Q:", "%", "1,000", "0"]

texts = st.lists(st.lists(st.sampled_from(PIECES), min_size=0, max_size=12).map("".join),
                 min_size=20, max_size=40)


@settings(max_examples=8, deadline=None, derandomize=True)
@given(texts)
def test_extractors_agree_with_sql(spark, sample):
    rows = list(enumerate(sample))
    df = spark.createDataFrame(rows, "i int, t string")
    got = df.select("i", A.extract_answer("t").alias("a"), A.extract_answer_plain("t").alias("b"),
                    A.extract_predicted_answer("t").alias("c"), A.extract_keyword_answer("t").alias("d"),
                    A.clean_number_text("t").alias("e")).orderBy("i").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", rows)
    want = con.execute(f"""SELECT i, {O.extract_answer('t')}, {O.extract_answer_plain('t')},
                                  {O.extract_predicted('t')}, {O.extract_keyword('t')}, {O.clean('t')}
                           FROM x ORDER BY i""").fetchall()
    for g, w in zip(got, want):
        assert tuple(g) == tuple(w), (sample[g.i], tuple(g), w)


SHAPE_PIECES = ["Question: ", "\nSolution:", "\nEquation:", "\nAnswer:", "Answer:", "Rationale:", "Options:",
                "\n", " ", "  x ", "y", "12", "A. 3\n"]
shape_texts = st.lists(st.tuples(st.sampled_from(["ASDiv", "ParaMAWPS", "SVAMP", "DMath", "AQuA"]),
                                 st.lists(st.sampled_from(SHAPE_PIECES), min_size=0, max_size=10).map("".join)),
                       min_size=20, max_size=40)


@settings(max_examples=6, deadline=None, derandomize=True)
@given(shape_texts)
def test_standardise_agrees_with_sql(spark, sample):
    from mathtide.plans import curriculum as CU
    rows = [(d, 0, i, t) for i, (d, t) in enumerate(sample)]
    df = spark.createDataFrame(rows, "dataset string, stage int, row_key long, text string")
    got = sorted(tuple(r) for r in CU.standardised(df).select("row_key", "question", "answer").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE rendered (dataset VARCHAR, stage INTEGER, row_key BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO rendered VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(O.with_views(O.V_STANDARD) + " SELECT row_key, question, answer FROM standard")
                  .fetchall())
    assert got == want
