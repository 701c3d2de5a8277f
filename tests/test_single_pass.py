"""Costly steps are computed once: answers before a join, prompts before two readers."""

from conftest import SF_SMALL
from mathtide.plans import queries as Q
from mathtide.plans import views as V


def _above_join(df) -> str:
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return "\n".join(lines[:next(i for i, line in enumerate(lines) if "Join" in line) + 1])


def test_stream_accuracy_extracts_below_the_join(spark):
    from mathtide.streaming import jobs as J
    judged = J.stream_accuracy(V.responses(spark, SF_SMALL), V.gold(spark, SF_SMALL))
    assert "####" not in _above_join(judged) and "#### " not in _above_join(judged)
    assert sum(r["n_total"] for r in judged.collect()) == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()


def test_staged_batches_hold_a_file_per_core(spark, monkeypatch):
    from mathtide.streaming import jobs as J
    files, plain = [], J.stage_in_order

    def counted(*args, **kwargs):
        files.append(plain(*args, **kwargs))
        return files[-1]
    monkeypatch.setattr(J, "stage_in_order", counted)
    Q._staged(spark, SF_SMALL, "lineitem", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])
    assert files[0] >= 3 * spark.sparkContext.defaultParallelism


def test_curriculum_prompts_are_made_once(spark, monkeypatch):
    from mathtide.operators import tokens as T
    leaves, plain = [], T.fit_vocabulary

    def seen(df, *args):
        found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        leaves.extend(found.apply(i).getClass().getSimpleName() for i in range(found.size()))
        return plain(df, *args)
    monkeypatch.setattr(T, "fit_vocabulary", seen)
    assert Q.curriculum_tokens(spark, SF_SMALL).count() > 0
    assert leaves == ["LogicalRDD"]
