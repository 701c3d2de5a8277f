"""Run logs and table counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.operators.ranking import running_totals


def source_counts(df: DataFrame, source: str = "source", sample: int | None = None,
                  order_by: Sequence[str] | None = None) -> DataFrame:
    """Rows per source, over the whole table or a peek at the first ``sample``.

    The peek is a limit by design (the reference inspects 1000 records); it
    is a key-ordered TakeOrderedAndProject, deterministic at any partitioning.
    """
    data = df
    if sample is not None:
        if not order_by:
            raise ValueError("a sampled count needs a key order")
        from mathtide.operators.sampling import take
        data = take(df, sample, list(order_by))
    return data.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def _col(c) -> F.Column:
    return F.col(c) if isinstance(c, str) else c


def _elapsed_s(later, earlier) -> F.Column:
    """Seconds between two timestamps, exact in microseconds and independent
    of the session time zone (log timestamps carry none)."""
    return F.timestamp_diff("MICROSECOND", _col(earlier), _col(later)) / F.lit(1e6)


def step_index(log: DataFrame, run: str = "run", order_by: Sequence[str] = ("ts", "event_id"),
               step: str = "step") -> DataFrame:
    """1-based step number per run in time order (skew-safe, exact)."""
    ranked = running_totals(log, order_by=list(order_by), partition_by=[run], rank_col="__r")
    return ranked.withColumn(step, F.col("__r") + 1).drop("__r")


def training_speed(log: DataFrame, run: str = "run", order_by: Sequence[str] = ("ts", "event_id"),
                   ts: str = "ts", batch: str = "batch", accumulation: str = "accumulation",
                   world_size: int = 1, every: int = 10) -> DataFrame:
    """F2 + C6: every ``every`` steps, samples/second and seconds/step so far.

    Steps are numbered per run in ``order_by`` order.  Samples per step =
    device batch x accumulation x ``world_size`` (the reference counts one
    device, Q18).  The clock starts at the run's first step: elapsed = ts -
    first ts.  Step numbers and sample totals come from one skew-safe pass.
    """
    per_step = (F.col(batch) * F.col(accumulation) * F.lit(world_size)).cast("long")
    data = log.withColumn("__samples", per_step)
    ranked = running_totals(data, order_by=list(order_by), partition_by=[run], sums=["__samples"],
                            rank_col="__r", sum_prefix="total")
    starts = log.groupBy(run).agg(F.min(ts).alias("__start"))
    stepped = ranked.withColumn("step", F.col("__r") + 1).where((F.col("step") % every) == 0)
    # null-safe: a log row without a run id still belongs to the (null) run
    out = (stepped.alias("__a").join(starts.alias("__b"), F.col(f"__a.{run}").eqNullSafe(F.col(f"__b.{run}")))
           .select("__a.*", "__b.__start")
           .withColumn("elapsed_s", _elapsed_s(ts, "__start")))
    return out.select(
        run, "step", F.col("total__samples").alias("total_samples"), "elapsed_s",
        F.when(F.col("elapsed_s") > 0, F.col("total__samples") / F.col("elapsed_s")).alias("samples_per_second"),
        (F.col("elapsed_s") / F.col("step")).alias("seconds_per_step"))


def run_summary(log: DataFrame, run: str = "run", ts: str = "ts", step: str | None = None,
                memory: str | None = None) -> DataFrame:
    """Per run total time, steps, steps/second (and peak memory if logged).

    Without a ``step`` column every log row is one step.
    """
    steps = F.max(step) if step else F.count(F.lit(1))
    aggs = [_elapsed_s(F.max(ts), F.min(ts)).alias("total_time_s"),
            steps.cast("long").alias("max_steps"), F.count(F.lit(1)).alias("n_rows")]
    if memory:
        aggs.append(F.max(memory).alias("peak_memory"))
    out = log.groupBy(run).agg(*aggs)
    return out.withColumn("steps_per_second",
                          F.when(F.col("total_time_s") > 0, F.col("max_steps") / F.col("total_time_s")))
