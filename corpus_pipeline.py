"""From raw documents to training shards in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathtide.llm import decontaminate, mixing, quality_classifier, simhash, token_output
from mathtide.llm.common import keep, stored, table


def own_names(stage: Callable) -> Callable:
    """The stage with the columns of ``docs`` that begin as the operators' inner
    ones do ("__") under other names meanwhile, so that none clash."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prefix = "kept_"
        while any(c.startswith(prefix) for c in docs.columns):
            prefix += "_"
        names = {c: f"{prefix}{k}" for k, c in enumerate(docs.columns) if c.startswith("__")}
        out = stage(spark, docs.withColumnsRenamed(names) if names else docs, sf_dir)
        return out.withColumnsRenamed({new: c for c, new in names.items() if new in out.columns}) if names else out
    return run_stage


@own_names
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    # a row number keeps the filter above the projection that computes the score: pushed below
    # it, the filter would hold every statistic once for each rule
    scored = quality_classifier.classify(docs, model).withColumn("__row", F.monotonically_increasing_id())
    good = (F.col("__score") >= quality_classifier.CUTOFF) & (F.col("__row") >= 0)
    return scored.where(good).select(*docs.columns)


@own_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    rows = stored(docs)
    return rows.join(simhash.survivors(rows), ["__file", "__pos"], "left_semi").select(*docs.columns)


@own_names
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = stored(docs)
    leaks = decontaminate.find(rows, table(spark, sf_dir, "benchmark"), key=("__file", "__pos"))
    return rows.join(leaks.select("__file", "__pos").distinct(), ["__file", "__pos"], "left_anti").select(*docs.columns)


@own_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a repeated document is repeated rows."""
    rows = stored(docs)
    mixed = mixing.mix(rows, carry=("__file", "__pos")).select("__file", "__pos", "size", "taken")
    return mixing.taken_documents(rows, mixed, ["__file", "__pos"]).select(*docs.columns)


@own_names
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; one row per sequence."""
    return token_output.materialise(docs).drop("path")


STAGES = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("source mixing", mix_sources),
    ("token shards", write_tokens),
]

# a trained classifier and XXH64 fingerprints have no DuckDB form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
