"""Seeded sampling, shuffling, splitting and takes.

Randomness is a hash: row order is ``md5('{seed}:{key}')`` with the key as a
tie-break.  The same seed gives the same rows at any partitioning, after any
executor loss, and in DuckDB, which computes the same md5.

Global positions come from ``running_totals`` (range partitions + offsets),
never from a window without a partition key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mathtide.operators.ranking import global_rank, running_totals
from mathtide.operators.selection import hash_smallest, ordered_hex, row_hash

# A take keeps n rows per partition and merges them in one task.  A sample of
# more rows than this is chosen by hash digits instead: the same rows.
MERGED_SAMPLE = 100_000

HASH_COL = "__hash"


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hash_order(seed: int, key: str | Sequence[str]) -> Column:
    """md5 of 'seed:key' (multi-column keys joined with ':')."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in _keys(key)]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def take(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in a key order (each partition keeps n rows, then
    they are merged).  Ties beyond the order are broken by a hash of the row."""
    return df.withColumn("__row", row_hash(df)).orderBy(*order_by, "__row").limit(n).drop("__row")


def _integral(df: DataFrame, col: str) -> bool:
    from pyspark.sql import types as T
    return isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def take_per_group(df: DataFrame, n: int, group: str | Sequence[str],
                   order_by: Sequence[str]) -> DataFrame:
    """G2 per dataset: first ``n`` rows of every group (a cap such as 15000).

    Exact and skew-safe.  With one integral order key the rows are chosen by
    the digit selection over the key's ordered hex form (aggregates only, no
    row moves); otherwise they are ranked by ``running_totals``.  Null keys come
    first; ties are broken by a hash of the row.
    """
    order_by = list(order_by)
    if len(order_by) == 1 and _integral(df, order_by[0]):
        out = hash_smallest(df, order_by, ordered_hex(order_by[0]), n, _keys(group), "__in", levels=4)
        return out.where("__in").drop("__in")
    ranked = running_totals(df.withColumn("__row", row_hash(df)), order_by=[*order_by, "__row"],
                            partition_by=_keys(group), rank_col="__pos")
    return ranked.where(F.col("__pos") < n).drop("__pos", "__row")


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str | Sequence[str] = "id",
             rank_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """``min(n, size)`` rows without replacement, seeded.

    The draw order is (hash, key): ``order_col`` keeps the hash under that
    name (sort by it and the key to lay shots out), ``rank_col`` adds the
    0-based draw position.
    """
    keys = _keys(key)
    if n > MERGED_SAMPLE:
        picked = hash_smallest(df, keys, hash_order(seed, keys), n, flag="__in").where("__in").drop("__in")
        picked = picked.withColumn(HASH_COL, hash_order(seed, keys))
    else:
        picked = df.withColumns({HASH_COL: hash_order(seed, keys), "__row": row_hash(df)}) \
            .orderBy(HASH_COL, *keys, "__row").limit(n).drop("__row")
    if rank_col:
        picked = picked.withColumn("__row", row_hash(df))
        picked = global_rank(picked, [HASH_COL, *keys, "__row"], rank_col).drop("__row")
    return picked.withColumnRenamed(HASH_COL, order_col) if order_col else picked.drop(HASH_COL)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42,
                    key: str | Sequence[str] = "id") -> DataFrame:
    """Exactly ``int(size * fraction)`` rows, chosen by hash digits
    (aggregates over the key columns; the table is scanned, never shuffled)."""
    keys = _keys(key)
    return hash_smallest(df, keys, hash_order(seed, keys), lambda n: F.floor(n * F.lit(float(fraction))),
                         flag="__in").where("__in").drop("__in")


def shuffle(df: DataFrame, seed: int = 42, key: str | Sequence[str] = "id",
            position: str | None = "shuffle_pos") -> DataFrame:
    """Full seeded shuffle.

    With ``position`` each row gets its 0-based place in the shuffled order;
    without it the frame is returned range-partitioned and sorted by the hash.
    """
    keys = _keys(key)
    h = df.withColumn(HASH_COL, hash_order(seed, keys))
    if position:
        h = h.withColumn("__row", row_hash(df))
        return global_rank(h, [HASH_COL, *keys, "__row"], position).drop(HASH_COL, "__row")
    return h.orderBy(HASH_COL, *keys).drop(HASH_COL)


def train_test_split(df: DataFrame, test_size: float = 0.1, seed: int = 42,
                     key: str | Sequence[str] = "id", group: str | Sequence[str] | None = None,
                     split_col: str = "split", positions: bool = True) -> DataFrame:
    """Disjoint exact-count split after a seeded shuffle.

    Test takes the first ``ceil(test_size * n)`` rows of the shuffled order
    (per ``group`` when given, e.g. per curriculum stage); the rest is train.
    With ``positions`` each row also gets ``shuffle_pos`` (its place in the
    shuffled order of its group, via the slice-ranking helper); without, the
    split is decided by hash digits and no row is shuffled.
    """
    keys = _keys(key)
    groups = _keys(group) if group else []
    if not positions:
        # same double arithmetic as ceil(test_size * n) in Python
        out = hash_smallest(df, keys, hash_order(seed, keys),
                            lambda n: F.ceil(F.lit(float(test_size)) * n), groups, "__test")
        return out.withColumn(split_col, F.when(F.col("__test"), F.lit("test")).otherwise(F.lit("train"))) \
            .drop("__test")
    h = df.withColumns({HASH_COL: hash_order(seed, keys), "__row": row_hash(df)})
    ranked = running_totals(h, [HASH_COL, *keys, "__row"], groups, (), "__pos").drop("__row")
    sizes = h.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")) if groups else \
        h.agg(F.count(F.lit(1)).alias("__n"))
    # same double arithmetic as ceil(test_size * n) in Python
    n_test = F.ceil(F.lit(test_size) * F.col("__n"))
    if groups:
        cond = [F.col(f"__r.{g}").eqNullSafe(F.col(f"__z.{g}")) for g in groups]
        ranked = ranked.alias("__r").join(sizes.alias("__z"), cond, "inner").select("__r.*", "__z.__n")
    else:
        ranked = ranked.withColumn("__n", sizes.scalar())
    out = ranked.withColumn(split_col, F.when(F.col("__pos") < n_test, F.lit("test")).otherwise(F.lit("train")))
    return out.drop(HASH_COL, "__n").withColumnRenamed("__pos", "shuffle_pos")


def nth_row(df: DataFrame, i: int, order_by: Sequence[str]) -> DataFrame:
    """The row at 0-based position ``i`` in key order: the last of the first
    i + 1 rows (only those are numbered)."""
    w = Window.orderBy(*order_by, "__row")
    first = df.withColumn("__row", row_hash(df)).orderBy(*order_by, "__row").limit(i + 1)
    return first.withColumn("__pos", F.row_number().over(w)).where(F.col("__pos") == i + 1).drop("__pos", "__row")
