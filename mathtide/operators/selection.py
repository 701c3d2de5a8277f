"""Exact k-smallest selection without moving rows.

A seeded sample or a train/test split keeps, per group, the ``k`` rows with the
smallest ``md5('seed:key')``.  Ranking every row would shuffle the whole table;
instead the threshold is found digit by digit, the same way at every size:

* per level one partial aggregate counts each group's undecided rows by the next
  4 hex digits of the order text (65 536 buckets at most), and a per-group window
  over that small table finds the bucket holding the k-th row;
* rows whose text starts below the chosen digits are in, rows above are out;
  only rows inside the chosen bucket (one in 65 536 per level unless many share
  a text) are ranked exactly by (text, keys, hash of the whole row), in slices,
  so a text that a third of the rows share is no single task;
* the answer is the union of the decided rows and the ranked ones.  Nothing is
  joined on keys, so repeated keys keep their number; a null order text is the
  empty text and comes first.

The per-group thresholds are joined by a broadcast while they are few, which is
counted first, and by an ordinary join beyond that; the rows are the same.  Each
level reads the input once, so an expensive upstream plan is best checkpointed
by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathtide.operators.ranking import global_rank
from mathtide.session import checkpoint_dir

DIGITS = 4                     # hex digits per level (65 536 buckets)
BROADCAST_GROUPS = 1_000_000   # thresholds shipped to every task; more are joined by a shuffle
_H = "__h"


def _cols(c) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


def ordered_hex(c) -> Column:
    """A long as 16 hex digits whose text order is the number order (sign bit
    flipped, so negatives sort first); null stays null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lpad(F.lower(F.hex(col.cast("long").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: rows that differ get an order
    of their own, whatever partition they come from."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def hash_smallest(df: DataFrame, keys: str | Sequence[str], hash_col: Column,
                  k: int | Callable[[Column], Column], groups: str | Sequence[str] = (),
                  flag: str = "selected", levels: int = 1) -> DataFrame:
    """Add boolean ``flag``: row is among its group's ``k`` first by
    (``hash_col``, ``keys``, hash of the row).

    ``hash_col`` is text whose string order is the wanted order: an md5, or
    ``ordered_hex`` of a number (then ``levels=4``).  ``k`` is a count or maps the
    column of a group's size to its count.  Exactly min(k, size) rows per group
    are flagged, also where keys or whole rows repeat.
    """
    keys, groups = _cols(keys), _cols(groups)
    hashed = df.withColumn(_H, F.coalesce(hash_col, F.lit("")))
    checkpoint_dir(df.sparkSession)
    state = None
    for level in range(levels):
        rows = hashed.select(*groups, _H)
        if state is not None:
            rows = _with_state(rows, state, groups, "inner").where(F.substring(_H, 1, level * DIGITS) == F.col("__p"))
        counts = rows.groupBy(*groups, F.substring(_H, 1, (level + 1) * DIGITS).alias("__d")).agg(
            F.count(F.lit(1)).alias("__c"))
        per_group = Window.partitionBy(*groups)
        running = per_group.orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumns({"__cum": F.sum("__c").over(running), "__n": F.sum("__c").over(per_group)})
        if state is None:
            want = k(F.col("__n")) if callable(k) else F.lit(int(k))
            counts = counts.withColumn("__need", F.least(want.cast("long"), F.col("__n")))
        else:
            counts = _with_state(counts, state, groups, "inner").drop("__p")
        before = F.col("__cum") - F.col("__c")
        state = counts.where((F.col("__cum") >= F.col("__need")) & (before < F.col("__need"))).select(
            *groups, F.col("__d").alias("__p"), (F.col("__need") - before).alias("__need")).checkpoint()
    marked = _with_state(hashed, state, groups, "left")
    text = F.substring(_H, 1, levels * DIGITS)
    inside = F.coalesce(text == F.col("__p"), F.lit(False))
    columns = [F.col(f"`{c}`") for c in df.columns]
    decided = marked.where(~inside).select(*columns, F.coalesce(text < F.col("__p"), F.lit(False)).alias(flag))
    open_rows = marked.where(inside).withColumn("__row", row_hash(df)).checkpoint()
    ranked = global_rank(open_rows, [_H, *keys, "__row"], "__r", groups)
    return decided.unionByName(ranked.select(*columns, (F.col("__r") < F.col("__need")).alias(flag)))


def _with_state(left: DataFrame, state: DataFrame, groups: list[str], how: str) -> DataFrame:
    """Attach the groups' (__p, __need): one row without groups, else an
    equi-join on the group columns."""
    if not groups:
        one = F.broadcast(state.withColumn("__one", F.lit(1)))       # at most one row
        return left.withColumn("__one", F.lit(1)).join(one, "__one", how).drop("__one")
    small = state.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    right = F.broadcast(state.alias("__s")) if small else state.alias("__s")
    cond = [F.col(f"__l.{g}").eqNullSafe(F.col(f"__s.{g}")) for g in groups]
    return left.alias("__l").join(right, cond, how).select("__l.*", "__s.__p", "__s.__need")
