"""Votes, accuracy and the skew-safe ranking helper."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mathtide.operators import voting as VT
from mathtide.operators.ranking import running_totals


def test_majority_vote_cases(spark):
    rows = [("q1", i, v) for i, v in enumerate([2.0, 1.0, 1.0, 2.0])]
    rows += [("q2", 0, None), ("q2", 1, 4.0), ("q3", 0, None), ("q3", 1, None)]
    df = spark.createDataFrame(rows, "q string, idx int, a double")
    out = {r.q: r for r in VT.majority_vote(df, "q", "a", "idx").collect()}
    assert out["q1"].majority_answer == 2.0           # tie -> seen first
    assert out["q2"].majority_answer == 4.0
    assert out["q3"].majority_answer is None and out["q3"].n_votes == 2


def test_vote_invariant_to_partitioning(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"q": rng.integers(0, 50, 4000), "idx": np.arange(4000),
                        "a": rng.integers(0, 4, 4000).astype(float)})
    df = spark.createDataFrame(pdf)
    a = sorted(map(tuple, VT.majority_vote(df.repartition(1), "q", "a", "idx").collect()))
    b = sorted(map(tuple, VT.majority_vote(df.repartition(13, "a"), "q", "a", "idx").collect()))
    assert a == b


def test_accuracy_empty_is_null(spark):
    df = spark.createDataFrame([], "correct boolean")
    assert VT.accuracy(df, "correct").first().accuracy is None


def test_running_totals_exact_under_skew(spark):
    rng = np.random.default_rng(7)
    n = 6000
    run = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", None], n))
    pdf = pd.DataFrame({"run": run, "k": rng.permutation(n), "v": rng.integers(0, 2, n)})
    df = spark.createDataFrame(pdf, "run string, k long, v long")
    out = running_totals(df, ["k"], ["run"], ["v"], "idx", num_slices=7).toPandas()
    exp = pdf.sort_values(["run", "k"], na_position="first").copy()
    exp["idx"] = exp.groupby("run", dropna=False).cumcount()
    exp["running_v"] = exp.groupby("run", dropna=False)["v"].cumsum()
    got = out.sort_values(["run", "k"], na_position="first").reset_index(drop=True)
    exp = exp.reset_index(drop=True)
    assert len(got) == n
    assert (got["idx"].to_numpy() == exp["idx"].to_numpy()).all()
    assert (got["running_v"].to_numpy() == exp["running_v"].to_numpy()).all()


def test_running_totals_global(spark):
    df = spark.range(0, 1000).withColumn("v", F.lit(1))
    out = running_totals(df, ["id"], [], ["v"], "pos", num_slices=5)
    bad = out.where((F.col("pos") != F.col("id")) | (F.col("running_v") != F.col("id") + 1)).count()
    assert bad == 0


def test_running_accuracy(spark):
    df = spark.createDataFrame([("r", 1, True), ("r", 2, False), ("r", 3, True), ("s", 1, False)],
                               "run string, q int, correct boolean")
    got = {(r.run, r.q): (r.example_idx, r.running_accuracy)
           for r in VT.running_accuracy(df, "correct", ["q"], "run").collect()}
    assert got[("r", 3)] == (2, 2 / 3) and got[("s", 1)] == (0, 0.0)


def test_collect_votes_chunked(spark):
    rows = [("hot", i, float(i % 3)) for i in range(25)] + [("cold", 0, 1.0)]
    df = spark.createDataFrame(rows, "q string, idx int, a double")
    whole = {r.q: r["as"] for r in VT.collect_votes(df, "q", "idx", ["a"], chunk_size=10**6).collect()}
    assert whole["hot"] == [float(i % 3) for i in range(25)]
    chunks = VT.collect_votes(df, "q", "idx", ["a"], chunk_size=10).collect()
    hot = sorted((r.chunk, r["as"]) for r in chunks if r.q == "hot")
    assert [c for c, _ in hot] == [0, 1, 2] and sum((a for _, a in hot), []) == whole["hot"]


def test_votes_for_method_caps_only_when_needed(spark):
    from mathtide.plans import evaluation as EV
    rows = [("q1", i, float(i)) for i in range(12)] + [("q2", 0, 1.0)]
    df = spark.createDataFrame(rows, "q string, v int, a double")
    kept = EV.votes_for_method(df, ["q"], "v", "maj@8")
    assert sorted(r.v for r in kept.where("q = 'q1'").collect()) == list(range(8))
    assert EV.votes_for_method(df, ["q"], "v", "maj@k", n_votes=20).count() == 13
    assert EV.votes_for_method(df, ["q"], "v", "none").where("q = 'q1'").count() == 1


def test_majority_vote_hot_question_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 9000
    q = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 400, n))      # question 0 holds a third
    pdf = pd.DataFrame({"q": q, "pos": np.arange(n), "a": rng.integers(0, 5, n).astype(float)})
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    spark_df = spark.createDataFrame(pdf.astype({"q": "int64", "pos": "int64"}))
    got = {r.q: r.majority_answer for r in VT.majority_vote(spark_df.repartition(7), "q", "a", "pos").collect()}

    def brute(g):
        g = g.sort_values("pos").dropna(subset=["a"])
        if g.empty:
            return None
        counts = g.groupby("a").agg(c=("pos", "size"), first=("pos", "min")).reset_index()
        return float(counts.sort_values(["c", "first"], ascending=[False, True]).iloc[0]["a"])
    want = {k: brute(g) for k, g in pdf.groupby("q")}
    assert got == want


def test_unanswered_questions_count_as_wrong_in_every_run(spark):
    from mathtide.plans import evaluation as EV
    gold = spark.createDataFrame([(1, "#### 3"), (2, "#### 4"), (3, "#### 5")], "question_id long, answer string")
    resp = spark.createDataFrame([("a", 1, 0, "so #### 3"), ("a", 1, 1, "#### 9"), ("b", 1, 0, "#### 3"),
                                  ("b", 2, 0, "it is 4"), (None, 3, 0, "5")],
                                 "run string, question_id long, vote int, response string")
    res = EV.evaluate(resp, gold)
    got = {r.run: (r.n_total, r.n_correct) for r in EV.accuracy_by_run(res, gold=gold).collect()}
    assert got == {"a": (3, 1), "b": (3, 2), None: (3, 1)}
    answered = {r.run: (r.n_total, r.n_correct) for r in EV.accuracy_by_run(res).collect()}
    assert answered == {"a": (1, 1), "b": (2, 2), None: (1, 1)}


def test_vote_caps_keep_null_keys(spark):
    from mathtide.plans import evaluation as EV
    rows = [(None, "q", i) for i in range(3)] + [("r", None, i) for i in range(12)] + [("r", "q", i) for i in range(12)]
    df = spark.createDataFrame(rows, "run string, q string, v int")
    for k, want in ((20, 27), (8, 19), (2, 6)):
        assert EV.votes_for_method(df, ["run", "q"], "v", "maj@k", n_votes=k).count() == want


def test_totals_move_rows_once(spark):
    """After the range exchange and its checkpoint rows are not exchanged again, not even for many groups and sums."""
    df = spark.range(5000).select((F.col("id") % 700).alias("g"), "id", (F.col("id") % 2).alias("v"))
    out = running_totals(df, ["id"], ["g"], ["v"], num_slices=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    rows, totals = plan.split("BroadcastExchange")
    assert "Exchange" not in rows and "Window" not in rows


def test_totals_of_groups_across_batches_and_slices(spark):
    from pyspark.sql import Window
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.range(4000).select(
            F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 400).cast("string"))
            .alias("g"), (F.col("id") % 2 == 0).alias("b.c"), (F.col("id") * 7919 % 4001).alias("k"), "id")
        for by in (["g"], [], ["g", "id"]):
            w = Window.partitionBy(*by).orderBy("k")
            want = df.select("id", F.row_number().over(w) - 1, F.sum(F.col("`b.c`").cast("long")).over(w))
            for n in (1, 6):
                got = running_totals(df.withColumnRenamed("b.c", "b"), ["k"], by, ["b"], num_slices=n)
                assert sorted(map(tuple, got.select("id", "row_idx", "running_b").collect())) == sorted(map(tuple, want.collect()))
        assert "b.c" in running_totals(df, ["k"], ["g"], num_slices=2).columns
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
