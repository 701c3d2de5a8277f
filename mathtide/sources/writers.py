"""Writers (A9, A12, A13) and fixture writers for the source formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.operators.ranking import global_rank
from pyspark.sql import types as T

SPLIT_FORMATS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv"}

# Result names -- per-example CSV "{model}_gsm8k_{n_shot}shot_results.csv";
# vote results "{model basename}[_maj1@{n_votes}_temp{temperature}]_results.json".
SINGLE_RESULTS_NAME = "{model}_gsm8k_{n_shot}shot_results.csv"
VOTE_RESULTS_NAME = "{model}{majority}_results.json"
VOTE_SUFFIX = "_maj1@{n_votes}_temp{temperature}"


def single_results_name(model: str, n_shot: int) -> str:
    """Output name of the per-example results."""
    return SINGLE_RESULTS_NAME.format(model=model, n_shot=n_shot)


def vote_results_name(model: str, use_majority_vote: bool, n_votes: int, temperature: float) -> str:
    """Output name of the vote results (model basename, votes, temperature)."""
    majority = VOTE_SUFFIX.format(n_votes=n_votes, temperature=temperature) if use_majority_vote else ""
    return VOTE_RESULTS_NAME.format(model=model.split("/")[-1], majority=majority)


def _flatten_for_csv(df: DataFrame) -> DataFrame:
    """CSV holds no arrays or structs: encode them as JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def save_splits(df: DataFrame, out_dir: str, format: str = "parquet", split_col: str = "split",
                mode: str = "overwrite") -> None:
    """One output folder per split (partitioned by ``split_col``)."""
    fmt = SPLIT_FORMATS.get(format)
    if fmt is None:
        raise ValueError(f"Unsupported format: {format}")
    data = _flatten_for_csv(df) if fmt == "csv" else df
    writer = data.write.mode(mode).partitionBy(split_col).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(out_dir)


def write_results_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-example results with a header, arrays as JSON text."""
    _flatten_for_csv(df).write.mode(mode).option("header", True).csv(path)


def write_results_json(results: DataFrame, summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested per-question records and a separate one-row summary
    (accuracy, method, votes, ...) under ``path/results`` and ``path/summary``."""
    results.write.mode(mode).json(f"{path}/results")
    summary.coalesce(1).write.mode(mode).json(f"{path}/summary")


# ----------------------------------------------------- fixture writers ----

# Rows of a file: folders and their listing stay few at any size, a file is a few MB
ROWS_PER_FILE = 10_000


def _in_files(df: DataFrame, key: str, rows_per_file: int, rank: str | None) -> DataFrame:
    """Add ``__b``, a folder name per ``rows_per_file`` rows in key order; names
    sort as the rows do.  ``rank`` names a column that already holds a row's 0-based
    position in key order."""
    ranked = df.withColumnRenamed(rank, "__rank") if rank else global_rank(df, [key], "__rank")
    return ranked.withColumn("__b", F.lpad(F.floor(F.col("__rank") / rows_per_file).cast("string"), 8, "0"))


def write_json_arrays(df: DataFrame, path: str, key: str, rows_per_file: int = ROWS_PER_FILE,
                      rank: str | None = None) -> None:
    """Write rows in ``key`` order as files whose top level is a JSON array
    (ParaMAWPS/SVAMP form); the key itself is not written."""
    fields = [c for c in df.columns if c not in (key, rank)]
    rows = F.array_sort(F.collect_list(F.struct(F.col("__rank"), F.struct(*fields).alias("r"))))
    grouped = _in_files(df, key, rows_per_file, rank).groupBy("__b").agg(
        F.to_json(F.transform(rows, lambda x: x["r"])).alias("value"))
    grouped.write.mode("overwrite").partitionBy("__b").text(path)


def write_keyed_json(df: DataFrame, path: str, key: str, rows_per_file: int = ROWS_PER_FILE,
                     rank: str | None = None) -> None:
    """Write rows in ``key`` order as files each holding one object keyed by
    ``key`` (DMath form)."""
    fields = [c for c in df.columns if c not in (key, rank)]
    rows = F.array_sort(F.collect_list(F.struct(F.col("__rank"), F.col(key).cast("string").alias("k"),
                                                F.struct(*fields).alias("v"))))
    grouped = _in_files(df, key, rows_per_file, rank).groupBy("__b").agg(
        F.to_json(F.map_from_entries(F.transform(rows, lambda x: F.struct(x["k"], x["v"])))).alias("value"))
    grouped.write.mode("overwrite").partitionBy("__b").text(path)
