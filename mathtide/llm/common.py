"""Helpers shared by the operators of this subpackage.

Words are maximal runs of characters other than space and U+0009-U+000D; on
UTF-8 bytes that is exactly what ``bytes.split()`` cuts at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathtide.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, in the JVM."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """The words in order.  Blanks become one character first, so that the
    split needs no regular expression."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(key: str, n: int) -> Column:
    """crc32 of the key's text modulo n (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def keep(df: DataFrame, name: str = "llm") -> DataFrame:
    """The frame written once to the shared checkpoint folder and read back:
    cuts lineage, survives executor loss, and later passes do not recompute."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Add ``__file`` and ``__pos``: where a row lies in its files.

    The pair names a row at any split size and cluster size.  A frame that is
    no direct file scan is written once to the shared folder first.
    """
    from pyspark.errors import AnalysisException
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos")]
    df = df.drop("__file", "__pos")
    try:
        return df.select("*", *place)
    except AnalysisException:
        return keep(df, "stored").select("*", *place)


def least_hashed(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows (a parameter of some thousands) with the least xxhash64 of
    ``columns``, ties by the columns.  Rows beyond three times the expected
    threshold are filtered first, so a task keeps few rows for the merge however
    many tasks there are."""
    h = F.xxhash64(*columns)
    share = 3 * n / max(df.count(), 1)
    near = df.where(h <= int(-(1 << 63) + share * (1 << 64))) if share < 1 else df
    return near.orderBy(h, *columns).limit(n)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row (doc_id, y, text) per row of ``chosen`` (doc_id, y; a bounded sample)
    that has a document: where an id repeats, the text with the least SHA-256, null first."""
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    digest = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", digest).alias("text"))
