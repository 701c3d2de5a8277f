"""Exact ranks and running totals that survive skew.

``Window.partitionBy(run).orderBy(idx)`` sends a whole run to one task; with
few runs (an evaluation has one or two) that is one task for a third of the
data.  ``running_totals`` keeps the result exact without that bottleneck, and
moves rows once:

1. range-partition on (group keys, order keys) so a hot group is cut into many
   contiguous slices, and sort each slice;
2. number and sum every group's rows as the sorted slice streams by, in Arrow
   batches: a slice holds its groups one after the other, so no exchange on
   (slice, group) is needed;
3. checkpoint that once to the shared folder: range bounds come from a sample
   that depends on arrival order, so two evaluations could cut different slices;
4. totals per (slice, group) become offsets by a per-group window.  Only a slice's
   first group can have begun earlier, so at most one offset a slice is not zero;
   these are broadcast while they are few, and joined otherwise.

The order keys must make a total order within a group (add a unique key as a
tie-break): rows with equal keys land in the same slice, and a total order
makes every rerun after an executor loss produce the same ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathtide.session import checkpoint_dir

_PID = "__slice"
_GROUP = "__group"
_INDEX = "__index"
MOST_BROADCAST = 1_000_000     # slices whose offsets are broadcast


SLICE_BYTES = 64 << 20
# Spark's estimate of an input whose size it does not know
UNKNOWN_BYTES = 1 << 60


def input_slices(df: DataFrame, least: int | None = None) -> int:
    """At least one slice per core (or ``least``), about SLICE_BYTES per slice by the
    optimizer's size estimate; ``spark.sql.shuffle.partitions`` slices where
    Spark does not know the size.

    A checkpoint carries the estimate of the plan it was made from, which multiplies
    with every join whatever the data; it counts by its partitions, which are real.

    Slices are sorted (spilling as needed) and streamed batch by batch, so a
    large slice costs time, not memory; the count only sets the parallelism.
    """
    spark = df.sparkSession
    cores = least or max(spark.sparkContext.defaultParallelism, 1)
    def as_int(size):
        return int(size if isinstance(size, int) else size.toString())
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        est = as_int(plan.stats().sizeInBytes())
        # join estimates can multiply far beyond the data; the leaf scans bound it
        leaves = plan.collectLeaves()
        scanned, stored = 0, 0
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if leaf.getClass().getSimpleName() == "LogicalRDD":
                stored += leaf.rdd().getNumPartitions()
            else:
                scanned += as_int(leaf.stats().sizeInBytes())
    except Py4JError:  # no estimate: the configured partition count
        return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), cores)
    est = min(est, scanned)
    if est >= UNKNOWN_BYTES:
        return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), cores)
    return max(cores, stored + -(-est // SLICE_BYTES))


def _changes(column):
    """Per row after the first whether a pyarrow column differs from the row before (null equals null)."""
    import pyarrow.compute as pc
    now, was = column.slice(1), column.slice(0, len(column) - 1)
    nulls = pc.xor(pc.is_null(now), pc.is_null(was))
    return pc.or_(nulls, pc.fill_null(pc.not_equal(now, was), False))


def _number_slice(groups: list[str], sums: list[str], out_sums: list[str]):
    """Row number and running sums within the group, over batches of a sorted slice."""
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        last, index, held = None, -1, [0] * len(sums)       # of the last row so far
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            starts = np.zeros(n, dtype=bool)
            for g in groups:
                column = batch.column(batch.schema.get_field_index(g))
                if n > 1:
                    starts[1:] |= _changes(column).to_numpy(zero_copy_only=False)
                if last is not None:
                    pair = pa.concat_arrays([last[g], column.slice(0, 1)])
                    starts[0] |= _changes(pair)[0].as_py()
            begin = np.where(starts, np.arange(n), 0)
            np.maximum.accumulate(begin, out=begin)          # where the row's group begins in this batch
            opened = np.logical_or.accumulate(starts)        # whether it begins in this batch at all
            idx = np.arange(n) - begin + np.where(opened, 0, index + 1)
            arrays = [*batch.columns, pa.array(idx, pa.int64())]
            now = []
            for k, name in enumerate(sums):
                values = pc.fill_null(batch.column(batch.schema.get_field_index(name)), 0).to_numpy(zero_copy_only=False)
                total = np.cumsum(values)
                run = np.where(opened, total - (total - values)[begin], total + held[k])
                arrays.append(pa.array(run, pa.int64()))
                now.append(int(run[-1]))
            last = {g: batch.column(batch.schema.get_field_index(g)).slice(n - 1) for g in groups}
            index, held = int(idx[-1]), now
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, _INDEX, *out_sums])
    return fn


def running_totals(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                   sums: Sequence[str] = (), rank_col: str = "row_idx",
                   sum_prefix: str = "running_", num_slices: int | None = None) -> DataFrame:
    """Add a 0-based ``rank_col`` and inclusive running sums per group.

    ``sums`` are numeric columns (booleans count as 0/1); each gets a column
    ``{sum_prefix}{name}`` holding the sum over the group's rows up to and
    including the current one in ``order_by`` order.
    """
    order_by, partition_by, sums = list(order_by), list(partition_by), list(sums)
    n = num_slices or input_slices(df)
    vcols, lcols = [f"__v_{s}" for s in sums], [f"__l_{s}" for s in sums]
    data = df.withColumns({v: F.coalesce(F.col(s).cast("long"), F.lit(0)) for v, s in zip(vcols, sums)}) if sums else df
    ordered = [F.col(k).asc_nulls_first() for k in partition_by + order_by]
    checkpoint_dir(df.sparkSession)
    # plain names inside the Arrow pass: the frame's own may hold any character
    plain = {c: f"c{k}" for k, c in enumerate(data.columns)}
    placed = data.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered).toDF(*plain.values())
    schema = T.StructType([*placed.schema.fields, *[T.StructField(c, T.LongType()) for c in (_INDEX, *lcols)]])
    numbered = placed.mapInArrow(_number_slice([plain[c] for c in partition_by], [plain[v] for v in vcols], lcols), schema)
    local = (numbered.toDF(*data.columns, _INDEX, *lcols)
             .withColumn(_PID, F.spark_partition_id()).checkpoint(eager=True))

    group = F.xxhash64(*partition_by) if partition_by else F.lit(0).cast("long")
    local = local.withColumn(_GROUP, group)
    # the hash stands for the groups in shuffles; equal hashes of different
    # groups are kept apart by the columns themselves
    keys = [_PID, _GROUP] + partition_by
    totals = local.groupBy(*keys).agg(F.count(F.lit(1)).alias("__cnt"), *[F.sum(v).alias(f"__t{v}") for v in vcols])
    before = Window.partitionBy(_GROUP, *partition_by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.sum("__cnt").over(before).alias("__o"),
                            *[F.sum(f"__t{v}").over(before).alias(f"__o{v}") for v in vcols]).where("__o is not null")
    if n <= MOST_BROADCAST:         # at most one row a slice
        offsets = F.broadcast(offsets)
    cond = [F.col(f"__l.{_PID}") == F.col(f"__o.{_PID}"), F.col(f"__l.{_GROUP}") == F.col(f"__o.{_GROUP}")]
    cond += [F.col(f"__l.{c}").eqNullSafe(F.col(f"__o.{c}")) for c in partition_by]
    joined = local.alias("__l").join(offsets.alias("__o"), cond, "left")

    def whole(inside, earlier):
        return F.col(f"__l.`{inside}`") + F.coalesce(F.col(f"__o.`{earlier}`"), F.lit(0))
    return joined.select(
        *[F.col(f"__l.`{c}`") for c in df.columns], whole(_INDEX, "__o").alias(rank_col),
        *[whole(x, f"__o{v}").alias(f"{sum_prefix}{s}") for x, v, s in zip(lcols, vcols, sums)])


def global_rank(df: DataFrame, order_by: Sequence[str], rank_col: str = "row_idx",
                partition_by: Sequence[str] = (), num_slices: int | None = None) -> DataFrame:
    """0-based position of every row in ``order_by`` order (per group)."""
    return running_totals(df, order_by, partition_by, (), rank_col, num_slices=num_slices)
