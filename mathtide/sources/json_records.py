"""Records of JSON documents that are one array or one object, read by byte ranges.

A JSON array is one document, and Spark's multi-line reader gives a whole file to
one task.  Here a file is read as text cut behind every ``}``, which Spark does by
byte ranges, and the records are found again by structure:

1. per piece: its unescaped quotes, and how far brackets outside strings change the
   depth, both for a piece that starts outside a string and for one that starts inside;
2. per file split these add up, for both starts, to one small row; a window over a
   file's splits gives the true state, string or not and depth, at every split's start;
3. running sums inside a split then give the state behind every piece; a ``}``
   outside strings that brings the depth back to 1 ends a record.

Pieces are hashed by split once; records are put together there, and only a
split's first and last, at most two rows, are exchanged again.  A backslash never
stands before a ``}`` in JSON, so no escape crosses a piece.  A file whose strings
or brackets do not close raises an error that names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "block"]


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def _depth(text: Column, end: Column) -> Column:
    """Change of depth over a piece without escapes and the ``}`` behind it."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"[^"]*"', ""), r'"[^"]*\z', "")
    return _count(bare, "{") + _count(bare, "[") - _count(bare, "]") - F.when(end % 2 == 0, 1).otherwise(0)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with the number of quotes before them in their split (``before``),
    and the change of depth if the split starts outside (d0) or inside (d1) a string."""
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("pos"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    read = read.withColumn("plain", plain).withColumn("quotes", _count(F.col("plain"), '"'))
    read = read.withColumns({"outside": _depth(F.col("plain"), F.col("quotes")),
                             "inside": _depth(F.concat(F.lit('"'), "plain"), F.col("quotes") + 1)}).drop("plain")
    so_far = Window.partitionBy(*SPLIT).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    read = read.repartition(*SPLIT).withColumn("before", F.coalesce(F.sum("quotes").over(so_far), F.lit(0)))
    odd = F.col("before") % 2 == 1
    return read.withColumns({"d0": F.when(odd, F.col("inside")).otherwise(F.col("outside")),
                             "d1": F.when(odd, F.col("outside")).otherwise(F.col("inside"))})


def _split_starts(pieces: DataFrame) -> DataFrame:
    """file, block, odd (starts inside a string), depth, of every file split."""
    totals = pieces.groupBy(*SPLIT).agg(
        F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"), F.max("size").alias("size"),
        F.sum(F.octet_length("value") + 1).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    totals = totals.withColumn("odd", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    totals = totals.withColumn("d", F.when(F.col("odd"), F.col("d1")).otherwise(F.col("d0")))
    # the last piece of a file may lack its brace
    missing = F.when(F.sum("bytes").over(whole) > F.max("size").over(whole), 1).otherwise(0)
    closed = (F.sum("quotes").over(whole) % 2 == 0) & (F.sum("d").over(whole) + missing == 0)
    wrong = F.raise_error(F.concat(F.lit("strings or brackets do not close in "), "file"))
    return totals.select(*SPLIT, F.when(closed, F.col("odd")).otherwise(wrong.cast("boolean")).alias("odd"),
                         F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("depth"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``order_key`` (file, start of the split and place of the record's end) and ``record``, the text of
    every object one level below the document's array or object, with what stands before it."""
    pieces = _pieces(spark, path)
    pieces = pieces.drop("size").join(_split_starts(pieces), SPLIT)
    step = F.when(F.col("odd"), F.col("d1")).otherwise(F.col("d0"))
    within = Window.partitionBy(*SPLIT).orderBy("pos")
    here = within.rowsBetween(Window.unboundedPreceding, 0)
    string = (F.col("before") + F.col("quotes") + F.col("odd").cast("int")) % 2 == 1
    pieces = pieces.withColumn("ends", ~string & (F.col("depth") + F.sum(step).over(here) == 1))
    end = F.when(F.col("ends"), F.col("pos"))
    # the next end is the least so far from behind: a frame to the end of the split would be summed anew for every row
    behind = Window.partitionBy(*SPLIT).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = pieces.select(*SPLIT, "pos", "value", F.min(end).over(behind).alias("end"),
                          F.min(end).over(Window.partitionBy(*SPLIT)).alias("first"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"])
    # what lies inside a split: no row moves
    texts = known.groupBy(*SPLIT, "end", "first").agg(F.concat(F.array_join(in_order, "}"), F.lit("}")).alias("record"))
    border = F.col("end").isNull() | (F.col("end") == F.col("first"))
    whole = texts.where(~border).select(*SPLIT, "end", "record")

    # a split's first record may have begun in earlier ones, behind their last record: at most two rows a split
    opened = Window.partitionBy("file").orderBy("block", F.col("end").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    edges = texts.where(border).withColumn("nth", F.count("end").over(opened))
    across = F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p["record"])
    last = F.max(F.when(F.col("end").isNotNull(), F.struct("block", "end")))
    crossed = (edges.groupBy("file", "nth").agg(F.array_join(across, "").alias("record"), last.alias("e"))
               .where("e is not null").select("file", "e.block", "e.end", "record"))
    return whole.unionByName(crossed).select(F.struct("file", "block", F.col("end").alias("pos")).alias("order_key"), "record")
