"""Dataset profile and Parquet footer statistics."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathtide.operators.sampling import take_per_group


def dataset_profile(df: DataFrame, split: str = "split", key: str = "row_key", n_sample: int = 5) -> DataFrame:
    """A10: per split -- rows, column names, types, and the first rows (keys
    and the rows themselves as JSON).

    Counts are a partial aggregate; the sample is the first ``n_sample`` keys
    of every split through the skew-safe per-group take.
    """
    names = ",".join(c for c in df.columns)
    features = df.schema.simpleString()
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("num_examples"))
    first = take_per_group(df, n_sample, split, [key])
    # at most n_sample rows per split reach these lists
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("__k"),
                                                F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("__j"))))
    sample = first.groupBy(split).agg(rows.alias("__rows")).select(
        split,
        F.array_join(F.transform("__rows", lambda x: x["__k"].cast("string")), ",").alias("sample_keys"),
        F.concat(F.lit("["), F.array_join(F.transform("__rows", lambda x: x["__j"]), ","), F.lit("]"))
        .alias("sample_rows"))
    return (counts.join(sample, split, "left")
            .withColumn("column_names", F.lit(names)).withColumn("features", F.lit(features)))


# schemes that pyarrow's file systems open by themselves, and how it writes them
_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def _own_uri(spark: SparkSession, file: str) -> str:
    """The URI under which a task opens a file that Spark names ``file``: a mount
    (such as viewfs) is resolved to what it points at."""
    scheme = file.split(":", 1)[0]
    if scheme not in _SCHEMES:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(where).toString()
        scheme = file.split(":", 1)[0]
    rest = file.split(":", 1)[1]
    return f"{_SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """File, row_group, num_rows and total_bytes of every row group of a
    Parquet dataset.  The footers are read by tasks, some files each; no column is."""
    files = [(f, _own_uri(spark, f)) for f in spark.read.parquet(path).inputFiles()]
    listed = spark.createDataFrame(files, "file string, uri string")
    if len(files) > 1:
        listed = listed.repartition(min(len(files), 4 * spark.sparkContext.defaultParallelism), "file")

    def footers(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        for batch in batches:
            for file, uri in zip(batch.column("file").to_pylist(), batch.column("uri").to_pylist()):
                store, place = fs.FileSystem.from_uri(uri)
                with store.open_input_file(place) as source:
                    footer = pq.read_metadata(source)
                groups = [footer.row_group(k) for k in range(footer.num_row_groups)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(groups), pa.string()), pa.array(range(len(groups)), pa.int32()),
                     pa.array([g.num_rows for g in groups], pa.int64()), pa.array([g.total_byte_size for g in groups], pa.int64())],
                    ["file", "row_group", "num_rows", "total_bytes"])
    return listed.mapInArrow(footers, "file string, row_group int, num_rows long, total_bytes long")


def parquet_stats(spark: SparkSession, path: str, groups: bool = False) -> DataFrame:
    """Files, rows and size of a Parquet dataset, with ``groups`` also its row groups.

    No column is read: Spark counts the rows of the footers' row groups and
    names each file's size.  Size is shown in GB when at least 1 GB, else in MB.
    """
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
    per_file = files.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.max("file_size").alias("size"))
    total = per_file.agg(F.count(F.lit(1)).alias("num_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"),
                         F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"))
    if groups:
        total = total.withColumn("num_row_groups", row_groups(spark, path).agg(F.count(F.lit(1))).scalar())
    gb = F.col("size_bytes") / F.lit(1024 ** 3)
    mb = F.col("size_bytes") / F.lit(1024 ** 2)
    return total.withColumn("size_text", F.when(gb >= 1, F.concat(F.format_number(gb, 2), F.lit(" GB")))
                            .otherwise(F.concat(F.format_number(mb, 2), F.lit(" MB"))))
