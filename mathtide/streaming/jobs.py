"""Streaming forms of the corpus and evaluation operators.

The reference's streams are lazy record iterators with no event time, so
these are stateless projections or per-key aggregates over file streams; totals and
buffers that last from batch to batch are in ``carried``.
Each runs with an ``availableNow`` trigger into a sink in the shared
checkpoint folder; the checkpoint there makes a restarted query resume
exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathtide.functions import answers as A
from mathtide.operators import filters as C
from mathtide.operators import sampling as S
from mathtide.operators.ranking import global_rank, input_slices
from mathtide.session import checkpoint_dir, scratch_path
from mathtide.streaming.carried import PLACE, run_carried


def file_stream(spark: SparkSession, directory: str, file_glob: str = "*", max_bytes_per_trigger: int = 8 << 30,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream (schema from the footers), in
    micro-batches of about ``max_bytes_per_trigger``, or of a number of files."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(directory).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return reader.parquet(directory)


def table_stream(spark: SparkSession, table: str, max_bytes_per_trigger: int = 8 << 30) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getFileStatus(path).isDirectory():
        return file_stream(spark, table, max_bytes_per_trigger=max_bytes_per_trigger)
    return file_stream(spark, path.getParent().toString(), path.getName(), max_bytes_per_trigger)


def spread_stream(stream: DataFrame, directory: str) -> DataFrame:
    """Spread micro-batches over the cores before CPU-heavy work per row, if the
    files of ``directory`` have fewer splits than cores; on larger inputs nothing
    moves.  Rows go by a hash of all their columns (pass the narrow projection that the
    work needs): the same on a retry, without the sort of a round-robin repartition."""
    spark = stream.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if spark.read.parquet(directory).rdd.getNumPartitions() >= cores:
        return stream
    return stream.repartition(cores, F.xxhash64(*[F.col(f"`{c}`") for c in stream.columns]))


def stage_in_order(df: DataFrame, order: Sequence[str], path: str, position: str | None = None,
                   least_files: int = 3) -> int:
    """Write ``df`` as Parquet files that a stream reads in ``order`` (a total order of the rows); the number of files.

    One range exchange, one file per slice of about 64 MB, written in parallel.
    A file stream takes files by their modification time, so these are then set
    in the order of the slices.  ``position`` adds the 0-based place of a row.
    """
    spark = df.sparkSession
    if position:
        df, order = global_rank(df, list(order), position), [position]
    keys = [F.col(c).asc_nulls_first() for c in order]
    files = max(least_files, input_slices(df, 1))
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # part-<number>-..., the number of the slice
    written = sorted((f for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")),
                     key=lambda f: int(f.getPath().getName().split("-")[1]))
    last = max((f.getModificationTime() for f in written), default=0)
    for k, f in enumerate(written):
        at = last - 10 * (len(written) - 1 - k)
        store.setTimes(f.getPath(), at, -1)
        if store.getFileStatus(f.getPath()).getModificationTime() != at:
            raise ValueError(f"{path}: this store keeps no modification times, so a stream cannot be staged in order")
    return len(written)


def run_to_table(stream: DataFrame, name: str, mode: str = "append",
                 batch_fn: Callable[[DataFrame, int], DataFrame] | None = None, out: str | None = None,
                 checkpoint: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Drain a stream (availableNow) into parquet in the shared folder; return it as a table.
    With the ``out`` and ``checkpoint`` of an earlier call the query goes on where that one stopped.

    ``mode='update'`` is for aggregates by ``keys``: a micro-batch writes the groups
    it changed, and the table holds every group's newest row.

    ``mode='complete'`` rewrites the table each micro-batch (aggregates);
    ``batch_fn`` transforms every micro-batch before it is appended.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, f"{name}-out")
    ckpt = checkpoint or scratch_path(spark, f"{name}-ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        data = batch_fn(batch, batch_id) if batch_fn else batch
        if mode == "complete":
            data.write.mode("overwrite").parquet(out)
        else:
            # one folder per micro-batch, overwritten if the batch is replayed
            # after a failure: appends stay exactly-once
            data.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
             .foreachBatch(write_batch).trigger(availableNow=True).start())
    query.awaitTermination()
    table = spark.read.parquet(out)
    if mode == "update":
        rest = [c for c in table.columns if c not in (*keys, "_batch")]
        newest = F.max_by(F.struct(*rest), "_batch")
        return table.groupBy(*keys).agg(newest.alias("__newest")).select(*keys, "__newest.*")
    return table.drop("_batch") if "_batch" in table.columns else table


def stream_filter_map(stream: DataFrame, exclude_prefixes: Sequence[str], source: str,
                      project: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Filter -> format / tokenise on a stream (the batch functions, unchanged)."""
    return project(C.exclude_sources(stream, exclude_prefixes, source))


class _Enough(Exception):
    """Raised by a micro-batch that is not needed any more."""


def run_head(stream: DataFrame, n: int, name: str, order_by: Sequence[str], out: str | None = None,
             checkpoint: str | None = None) -> DataFrame:
    """The first ``n`` records of the stream as a table.  The micro-batch after
    the one that completes them ends the query before it reads anything.  Records of a micro-batch
    count in ``order_by`` order; what earlier micro-batches wrote counts after a restart, too."""
    spark = stream.sparkSession
    out, ckpt = out or scratch_path(spark, f"{name}-out"), checkpoint or scratch_path(spark, f"{name}-ckpt")
    schema = f"{stream.schema.toDDL()}, _batch long"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        have = 0 if batch_id == 0 else spark.read.schema(schema).parquet(out).where(F.col("_batch") < batch_id).count()
        if have >= n and batch_id > 0:
            raise _Enough
        # one task's merge of n rows from every partition
        S.take(batch, n - have, order_by).write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    query = (stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(write_batch)
             .trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if _Enough.__name__ not in str(e):
            raise
    return spark.read.schema(schema).parquet(out).drop("_batch")


def stream_source_counts(stream: DataFrame, source: str = "source") -> DataFrame:
    """Running count per source."""
    return stream.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def stream_accuracy(responses: DataFrame, gold: DataFrame, run: str = "run",
                    question: str = "question_id", response: str = "response",
                    gold_text: str = "answer") -> DataFrame:
    """Per run, responses and correct responses so far (stream-static join;
    the gold answers are extracted once, not per micro-batch).  A response's answer is a
    column of its own below the join: as part of the verdict it would be extracted for each use."""
    checkpoint_dir(gold.sparkSession)
    g = gold.select(question, A.extract_answer(F.col(gold_text)).alias("__gold")).checkpoint()
    answers = responses.select(run, question, A.extract_answer(F.col(response)).alias("__answer"))
    judged = answers.join(g, question, "left").withColumn("__ok", A.is_correct("__answer", "__gold"))
    return judged.groupBy(run).agg(F.count(F.lit(1)).alias("n_total"),
                                   F.sum(F.when(F.col("__ok"), 1).otherwise(0)).cast("long").alias("n_correct"))


def stream_training_speed(log: DataFrame, run: str = "run", ts: str = "ts", batch: str = "batch",
                          accumulation: str = "accumulation", world_size: int = 1) -> DataFrame:
    """Per run steps, samples and elapsed time so far."""
    samples = (F.col(batch) * F.col(accumulation) * F.lit(world_size)).cast("long")
    return log.groupBy(run).agg(F.count(F.lit(1)).alias("n_steps"), F.sum(samples).alias("total_samples"),
                                F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def stream_running_accuracy(judged: DataFrame, run: str = "run", correct: str = "correct",
                            out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """J5, per example: running accuracy after every example of a ``placed``
    stream, in the order it arrives.  Totals per run lie in Spark's state store
    (``carried``); ``out`` and ``checkpoint`` of an earlier call go on with it."""
    data = judged.withColumn("__ok", F.coalesce(F.col(correct).cast("boolean"), F.lit(False)).cast("long"))

    def project(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("running_correct__ok", "running_correct").drop("__ok").withColumn(
            "running_accuracy", F.col("running_correct") / (F.col("example_idx") + 1))
    return run_carried(data, [run], ["__ok"], "j5-running", project, rank="example_idx", prefix="running_correct",
                       out=out, checkpoint=checkpoint)


def stream_speed_steps(log: DataFrame, run: str = "run", ts: str = "ts", batch: str = "batch",
                       accumulation: str = "accumulation", world_size: int = 1, every: int = 10,
                       out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """J6, every ``every`` steps of a ``placed`` stream: samples/second and
    seconds/step; steps, samples and the first time of a run lie in Spark's state store."""
    data = log.select(run, ts, *PLACE, (F.col(batch) * F.col(accumulation) * F.lit(world_size)).cast("long").alias("__n"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("__ts"))

    def project(rows: DataFrame) -> DataFrame:
        step, elapsed = F.col("__step") + 1, (F.col("__ts") - F.col("__first")) / F.lit(1e6)
        return rows.where(step % every == 0).select(
            run, step.alias("step"), F.col("cum__n").alias("total_samples"), elapsed.alias("elapsed_s"),
            F.when(elapsed > 0, F.col("cum__n") / elapsed).alias("samples_per_second"),
            (elapsed / step).alias("seconds_per_step"))
    return run_carried(data, [run], ["__n"], "j6-steps", project, first="__ts", rank="__step", prefix="cum",
                       out=out, checkpoint=checkpoint)
