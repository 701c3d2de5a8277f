"""Totals and buffers that a stream carries from one micro-batch to the next.

All of it is kept in Spark's state store under the query's checkpoint, so a
query that is killed and started again on the same checkpoint goes on with the
state of its last committed batch, and a replayed batch sees the state it saw before.

A stream's order is the order of its files (modification time, then path) and of
the rows in them, across micro-batches.

Running totals: a group (a run of an evaluation, a training job) may hold most
rows, so its rows never pass through one stateful task.  Rows are summed per
(group, slice of a file) where they are read; only these heads, one row for some
ten thousand, go to the stateful operator, keyed by group, which adds the
state and returns where every slice starts.  Rows and starts travel together to the
sink, which sums within the slices and adds the starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mathtide.session import scratch_path

SLICE_ROWS = 1 << 16
PLACE = ["__time", "__file", "__pos"]
_HEAD = ["__group", "__time", "__file", "__block"]


def placed(stream: DataFrame) -> DataFrame:
    """A file stream with the place of every row: file time, file, row in it.
    Call it on the stream as it is read, before other steps."""
    return stream.select("*", F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("__time"),
                         F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos"))


def after(stream: DataFrame, time, file: str, pos: int) -> DataFrame:
    """A ``placed`` stream from behind a stated position on: the rows after row
    ``pos`` of ``file``, modified at ``time``.  A new query without the checkpoint of
    the old one goes on there; files that lie before are not opened."""
    t, f = F.lit(time).cast("timestamp_ntz"), F.lit(file)
    whole = (F.col("_metadata.file_modification_time").cast("timestamp_ntz") > t) | (
        (F.col("_metadata.file_modification_time").cast("timestamp_ntz") == t) & (F.col("_metadata.file_path") >= f))
    return stream.where(whole).where(F.struct("__time", "__file", "__pos") > F.struct(t, f, F.lit(pos).cast("long")))


def _group_key(group: Sequence[str]) -> Column:
    """The group as one string that is never null: lengths keep columns apart."""
    if not group:
        return F.lit("")
    text = [F.col(c).cast("string") for c in group]
    return F.concat(*[F.when(t.isNull(), F.lit("n")).otherwise(F.concat(F.length(t), F.lit(":"), t)) for t in text])


def with_starts(stream: DataFrame, group: Sequence[str], sums: Sequence[str],
                first: str | None = None) -> DataFrame:
    """The rows of a ``placed`` stream, and a row of ``__kind`` 1 for every slice
    of every group: rows and ``sums`` (longs) before it, and ``first`` (a long that is
    never null) of the group's first row, from the state store."""
    values = {f"__s_{s}": F.coalesce(F.col(s).cast("long"), F.lit(0)) for s in sums}
    rows = stream.withColumns({"__group": _group_key(group), "__block": F.floor(F.col("__pos") / SLICE_ROWS), **values,
                               **({"__first": F.col(first).cast("long")} if first else {})})
    names, firsts = list(values), ["__first"] if first else []
    columns = [*_HEAD, "__pos", *names, *firsts]
    counts = [f"__n_{k}" for k in range(len(values) + 1)]          # rows, then the sums
    numbers = ", ".join(f"{c} long" for c in [*counts, *firsts])
    place = "__group string, __time timestamp_ntz, __file string, __block long"

    def heads(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("__pos")
            table = table.append_column("__one", pa.array([1] * table.num_rows, pa.int64()))
            found = table.group_by(_HEAD, use_threads=False).aggregate(
                [("__one", "sum"), *[(v, "sum") for v in names], ("__pos", "min"), *[(f, "first") for f in firsts]])
            named = dict(zip(["__one_sum", *[f"{v}_sum" for v in names], "__pos_min", "__first_first"],
                             [*counts, "__at", "__first"]))
            found = found.rename_columns([named.get(c, c) for c in found.column_names])
            yield from found.select([*_HEAD, *counts, *firsts, "__at"]).to_batches()

    def starts(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd
        table = pd.concat(list(frames)).sort_values(["__time", "__file", "__block", "__at"])
        held = list(state.get) if state.exists else [0] * len(counts) + [int(table[f].iloc[0]) for f in firsts]
        per = table.groupby(["__time", "__file", "__block"], sort=True)[counts].sum()
        out = (per.cumsum() - per + held[:len(counts)]).reset_index()
        state.update((*[h + int(n) for h, n in zip(held, per.sum())], *held[len(counts):]))
        out.insert(0, "__group", key[0])
        for f, value in zip(firsts, held[len(counts):]):
            out[f] = value
        yield out

    offsets = rows.select(*columns).mapInArrow(heads, f"{place}, {numbers}, __at long").groupBy(
        "__group").applyInPandasWithState(starts, f"{place}, {numbers}", numbers, "append", GroupStateTimeout.NoTimeout)
    return rows.drop(*firsts).withColumn("__kind", F.lit(0)).unionByName(
        offsets.withColumn("__kind", F.lit(1)), allowMissingColumns=True)


def running(rows: DataFrame, starts: DataFrame, sums: Sequence[str], rank: str = "row_idx",
            prefix: str = "running_") -> DataFrame:
    """Rows with their 0-based number in the group, inclusive running sums and,
    if asked for, ``__first``: sums within slices, plus the slices' starts."""
    keys = ["__group", "__file", "__block"]
    inside = Window.partitionBy(*keys).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"__r": F.count(F.lit(1)).over(inside),
                               **{f"__w_{s}": F.sum(f"__s_{s}").over(inside) for s in sums}})
    begin = starts.select(*keys, F.col("__n_0").alias("__b_0"),
                          *[F.col(f"__n_{k + 1}").alias(f"__b_{k + 1}") for k in range(len(sums))],
                          *[c for c in ("__first",) if c in starts.columns])
    return summed.join(begin, keys).withColumns(
        {rank: F.col("__r") - 1 + F.col("__b_0"),
         **{f"{prefix}{s}": F.col(f"__w_{s}") + F.col(f"__b_{k + 1}") for k, s in enumerate(sums)}}).drop(
        "__r", "__kind", *[f"__w_{s}" for s in sums], *[f"__s_{s}" for s in sums],
        *[f"__b_{k}" for k in range(len(sums) + 1)], "__block", *PLACE, "__group")


def run_carried(stream: DataFrame, group: Sequence[str], sums: Sequence[str], name: str,
                project: Callable[[DataFrame], DataFrame], first: str | None = None, rank: str = "row_idx",
                prefix: str = "running_", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain a ``placed`` stream (availableNow): ``project`` of its rows with
    running totals, as a table.  With the ``out`` and ``checkpoint`` of an
    earlier call the query goes on where that one stopped."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, f"{name}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-ckpt")
    columns = stream.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        # the stateful plan runs once a batch; both kinds of rows come from its one result
        staged = f"{out}-staged/_batch={batch_id}"
        batch.write.mode("overwrite").partitionBy("__kind").parquet(staged)
        session = batch.sparkSession
        both = session.read.schema(batch.schema).parquet(staged)
        rows = both.where("__kind = 0").select(*columns, "__group", "__block", *[f"__s_{s}" for s in sums])
        starts = both.where("__kind = 1")
        project(running(rows, starts, sums, rank, prefix)).write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")
        _delete(session, staged)

    query = (with_starts(stream, group, sums, first).writeStream.option("checkpointLocation", checkpoint)
             .outputMode("append").foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out).drop("_batch")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


# -- buffered shuffle -------------------------------------------------------------------------------------------------------

_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def slot_of(position: Column, buffer_size: int, seed: int) -> Column:
    """The buffer slot that the record of a position goes to: the first fill the
    slots in order, each later one draws a slot by md5('seed:position')."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), position.cast("string"))), 1, 8), 16, 10)
    return F.when(position < buffer_size, position).otherwise(drawn.cast("long") % buffer_size)


def buffer_shuffle(stream: DataFrame, position: str, buffer_size: int = 10_000, seed: int = 42,
                   name: str = "shuffle", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Shuffle of a stream through a buffer of ``buffer_size`` records: it is
    filled, then every arriving record takes a drawn slot and the record that was
    there is emitted; at the end the buffer is emptied in a drawn order.

    ``position`` numbers the records from 0 in the order they arrive.  The
    record in a slot is that slot's state in Spark's state store, so slots are
    independent, any number of tasks share a micro-batch and the buffer outlives
    the query.  The draws depend on (seed, position) alone, so the order is the same
    at any number of micro-batches and after any restart.  A record comes forward by
    fewer than ``buffer_size`` places and may fall back any number of places.  Returns the records with ``shuffle_pos``, their place in the new order.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, f"{name}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-ckpt")
    schema = stream.schema
    packed = stream.select(slot_of(F.col(position), buffer_size, seed).alias("slot"), F.col(position).alias("at"),
                           F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns]), _TIMES).alias("record"))

    def displace(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd
        arrived = pd.concat(list(frames)).sort_values("at")
        at, record = arrived["at"].tolist(), arrived["record"].tolist()
        if state.exists:
            was, held = state.get
            if was >= at[0]:
                raise ValueError(f"position {at[0]} came after position {was}")
            at, record = [was, *at], [held, *record]
        state.update((int(at[-1]), record[-1]))
        if len(at) > 1:
            yield pd.DataFrame({"record": record[:-1], "shuffle_pos": [a - buffer_size for a in at[1:]]})

    moved = packed.groupBy("slot").applyInPandasWithState(
        displace, "record string, shuffle_pos long", "at long, record string", "append", GroupStateTimeout.NoTimeout)

    def unpacked(df: DataFrame) -> DataFrame:
        return df.select(F.from_json("record", schema, _TIMES).alias("r"), "shuffle_pos").select("r.*", "shuffle_pos")

    def write(batch: DataFrame, batch_id: int) -> None:
        unpacked(batch).write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    query = (moved.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(write)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    emitted = spark.read.schema(f"{schema.toDDL()}, shuffle_pos long, _batch int").parquet(out).drop("_batch")
    held = spark.read.format("statestore").load(checkpoint).select("key.slot", "value.groupState.*")
    # the buffer: at most buffer_size rows
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("end"), F.col("slot").cast("string"))), "slot")
    last = held.select("record", (F.row_number().over(order) - 1 + F.lit(emitted.count())).cast("long").alias("shuffle_pos"))
    return emitted.unionByName(unpacked(last))
