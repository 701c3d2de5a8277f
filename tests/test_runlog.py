"""Run-log operators on hand-computed cases."""

import datetime as dt

from mathtide.operators import runlog as R


def test_training_speed_and_summary(spark):
    start = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("r", i, start + dt.timedelta(seconds=2 * i), 4, 2, float(i)) for i in range(25)]
    rows += [("s", i, start + dt.timedelta(seconds=i), 1, 1, 1.0) for i in range(10)]
    log = spark.createDataFrame(rows, "run string, event_id long, ts timestamp_ntz, batch int, accumulation int, value double")
    got = {(r.run, r.step): r for r in R.training_speed(log).collect()}
    # run r: step 10 is event 9 at 18 s after the first step; 10 steps x 8 samples
    assert got[("r", 10)].total_samples == 80 and got[("r", 10)].elapsed_s == 18.0
    assert abs(got[("r", 10)].samples_per_second - 80 / 18) < 1e-12
    assert got[("r", 20)].seconds_per_step == 38.0 / 20
    assert ("s", 10) in got and got[("s", 10)].total_samples == 10
    assert sorted(k for k in got) == [("r", 10), ("r", 20), ("s", 10)]
    summary = {r.run: r for r in R.run_summary(log, memory="value").collect()}
    assert summary["r"].total_time_s == 48.0 and summary["r"].max_steps == 25 and summary["r"].peak_memory == 24.0
    assert summary["s"].steps_per_second == 10 / 9.0


def test_source_counts_peek(spark):
    df = spark.createDataFrame([(i, "data/PoT/a" if i % 3 == 0 else "data/CoT/b") for i in range(30)],
                               "k long, source string")
    full = {r.source: r.n for r in R.source_counts(df).collect()}
    peek = {r.source: r.n for r in R.source_counts(df, sample=6, order_by=["k"]).collect()}
    assert full == {"data/PoT/a": 10, "data/CoT/b": 20} and peek == {"data/PoT/a": 2, "data/CoT/b": 4}
