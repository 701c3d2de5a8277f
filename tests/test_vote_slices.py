"""The first k votes of every question are chosen in slices whose number follows the input."""

from pyspark.sql import functions as F

from mathtide.plans import evaluation as E


def test_first_votes_in_slices(spark, monkeypatch):
    monkeypatch.setattr(E, "input_slices", lambda df, least=None: 3)
    # question 0 holds a third of the votes, and there is a null question
    q = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 50)
    votes = spark.range(3000).select(q.alias("q"), (F.lit(5000) - F.col("id")).alias("vote"))
    out = E.votes_for_method(votes, ["q"], "vote", "maj@8")
    assert out.rdd.getNumPartitions() == 3 * E.SLICES_PER_INPUT and out.columns == ["q", "vote"]
    want = {}
    for r in sorted(votes.collect(), key=lambda r: r["vote"]):
        if len(want.setdefault(r["q"], [])) < 8:
            want[r["q"]].append(r["vote"])
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["vote"]):
        got.setdefault(r["q"], []).append(r["vote"])
    assert got == want
