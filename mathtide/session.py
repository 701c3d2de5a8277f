"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_SCRATCH: list[str] = []       # scratch paths given out by this process

# Settings chosen for large inputs: adaptive execution re-plans joins and
# partition counts from runtime statistics, splits skewed join partitions and
# coalesces tiny shuffle outputs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.enabled": "false",
    # checkpoint files of frames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "mathtide",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster leave ``master`` unset so spark-submit decides; tests pass
    ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and round-trip files.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    single-process ``local`` master gets a temporary folder; any other master is
    an error, since executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="mathtide-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder; it lasts until
    ``remove_scratch``."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote to scratch paths and return how many there
    were.  Call it when the frames read from them are no longer needed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def spread(df, spark: SparkSession | None = None):
    """Round-robin rebalance when a scan yields fewer partitions than cores.

    Few, large row groups (or one small file) leave most cores idle for the
    CPU-heavy string work before the first shuffle.  Apply it after a view's
    own filters and projection: filters below it reach the scan, and unused
    columns are still pruned through it.  On cluster-sized inputs
    the scan already has more partitions than the parallelism and this is a
    no-op.  Rows are spread by their number within the scan (deterministic
    there), so a retried task sends every row to the same partition again
    without the local sort a round-robin repartition needs for that.
    """
    from pyspark.sql import functions as F
    spark = spark or df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        # straight after a scan the row order is fixed, so the row number is a
        # deterministic spreading key: no sort, and no data column is named
        # (column pruning still reaches the scan)
        return (df.withColumn("__row", F.monotonically_increasing_id())
                .repartition(cores, "__row").drop("__row"))
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))
