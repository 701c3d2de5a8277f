"""Readers for word-problem sources, corpora and tables.

Every reader uses a fixed schema (no inference pass over the data) and adds
``order_key`` = (file, start of the file split, row number in it) where list
order matters.  ``load_source`` turns that into a row's 0-based position in its
source, the row key of datasets that carry no id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathtide.operators import filters as C
from mathtide.operators import shape as B
from mathtide.operators.ranking import global_rank
from mathtide.sources.json_records import json_records

QA_SCHEMA = T.StructType([T.StructField("question", T.StringType()),
                          T.StructField("answer", T.StringType())])
ASDIV_SCHEMA = T.StructType([T.StructField("Body", T.StringType()),
                             T.StructField("Question", T.StringType()),
                             T.StructField("Answer", T.StringType()),
                             T.StructField("Formula", T.StringType())])
PARAMAWPS_SCHEMA = T.StructType([T.StructField("original_text", T.StringType()),
                                 T.StructField("equation", T.StringType()),
                                 T.StructField("ans", T.StringType())])
SVAMP_SCHEMA = T.StructType([T.StructField("Body", T.StringType()),
                             T.StructField("Question", T.StringType()),
                             T.StructField("Equation", T.StringType()),
                             T.StructField("Answer", T.StringType())])
DMATH_VALUE = T.StructType([T.StructField("question_en", T.StringType()),
                            T.StructField("solution_code_en", T.StringType()),
                            T.StructField("answer_en", T.StringType())])
AQUA_SCHEMA = T.StructType([T.StructField("question", T.StringType()),
                            T.StructField("options", T.ArrayType(T.StringType())),
                            T.StructField("rationale", T.StringType()),
                            T.StructField("correct", T.StringType())])
LEADERBOARD_COLUMNS = ["Name", "Family", "Published", "Size (in Billion)", "GSM8K Performance",
                       "MATH Performance"]
CORPUS_SCHEMA = T.StructType([T.StructField("url", T.StringType()),
                              T.StructField("date", T.StringType()),
                              T.StructField("metadata", T.StringType()),
                              T.StructField("text", T.StringType())])


def _with_line_order(df: DataFrame) -> DataFrame:
    """Line order for line formats, fixed at read: (file, start offset of the
    file split, row number within the split) -- splits of one large file may
    land in tasks in any order, rows inside a split keep their order."""
    return df.withColumn("order_key", F.struct(F.col("_metadata.file_path").alias("file"),
                                               F.col("_metadata.file_block_start").alias("block"),
                                               F.monotonically_increasing_id().alias("pos")))


def read_qa_jsonl(spark: SparkSession, path: str, split: str | None = None,
                  schema: T.StructType = QA_SCHEMA) -> DataFrame:
    """A1: one JSON object per line -> question, answer (+ split)."""
    df = _with_line_order(spark.read.schema(schema).json(path))
    return df.withColumn("split", F.lit(split)) if split else df


def read_asdiv_xml(spark: SparkSession, path: str) -> DataFrame:
    """A2 + C2: every <Problem> at any depth; needs Question and Answer.

    Output: order_key, body, question, answer, formula (stripped, missing
    optional fields as '').
    """
    raw = _with_line_order(spark.read.format("xml").option("rowTag", "Problem").schema(ASDIV_SCHEMA).load(path))
    kept = C.has_required(raw, "Question", "Answer")
    s = B.py_strip
    return kept.select("order_key", s(F.coalesce("Body", F.lit(""))).alias("body"), s("Question").alias("question"),
                       s("Answer").alias("answer"), s(F.coalesce("Formula", F.lit(""))).alias("formula"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A3: files whose top level is an array of objects (ParaMAWPS, SVAMP).

    One file is read by many tasks (``json_records``); numbers read into string
    fields keep their JSON text, as ``str()`` does.  A file whose strings or
    brackets do not close is an error.
    """
    found = json_records(spark, path)
    text = F.regexp_replace("record", r"^[\s\[,]+", "")
    return found.select(F.from_json(text, schema).alias("rec"), "order_key").select("rec.*", "order_key")


def read_keyed_json(spark: SparkSession, path: str, value_schema: T.StructType = DMATH_VALUE) -> DataFrame:
    """A4: files holding one object id -> record (DMath); one row per id (``key``)
    in the object's order.  One file is read by many tasks (``json_records``); a
    file whose strings or brackets do not close is an error."""
    found = json_records(spark, path)
    text = F.concat(F.lit("{"), F.regexp_replace("record", r"^[\s{,]+", ""), F.lit("}"))
    parsed = found.select("order_key", F.explode(F.from_json(text, T.MapType(T.StringType(), value_schema)))
                          .alias("key", "rec"))
    return parsed.select("order_key", "key", "rec.*")


def read_aqua_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A5: JSONL with an ``options`` array."""
    return _with_line_order(spark.read.schema(AQUA_SCHEMA).json(path))


def read_leaderboard_csv(spark: SparkSession, path: str) -> DataFrame:
    """Leaderboard CSV with a header, columns in any order; the six columns
    as text, missing ones null, and ``row_key``, the row's 0-based position."""
    df = spark.read.option("header", True).csv(path)       # without a schema every column is text
    cols = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in LEADERBOARD_COLUMNS]
    return _positioned(_with_line_order(df).select(*cols, "order_key"), "row_key")


def load_corpus(spark: SparkSession, path: str, split: str | None = None,
                split_col: str = "split") -> DataFrame:
    """A saved table with named splits; the split filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col(split_col) == split) if split else df


# ---------------------------------------------------------------- A14 ------

def _positioned(df: DataFrame, name: str) -> DataFrame:
    """Replace ``order_key`` by the row's 0-based position in its source: never
    null, and the same at any split size."""
    return global_rank(df, ["order_key"], name).drop("order_key")


def _rendered(name: str, df: DataFrame) -> DataFrame:
    """Source rows -> (order_key, text) in the dataset's rendered form."""
    if name == "ASDiv":
        text = B.render_asdiv("body", "question", "answer", "formula")
    elif name == "ParaMAWPS":
        text = B.render_paramawps("original_text", "equation", "ans")
    elif name == "SVAMP":
        text = B.render_svamp("Body", "Question", "Equation", "Answer")
    elif name == "DMath":
        text = B.render_dmath("question_en", "solution_code_en", "answer_en")
    elif name == "AQuA":
        text = B.render_aqua("question", "options", "rationale", "correct")
    else:
        raise ValueError(f"unknown dataset {name!r}")
    return df.select("order_key", text.alias("text"))


def render_source(name: str, df: DataFrame) -> DataFrame:
    """Source rows -> (row_key, text) in the dataset's rendered form; the row key
    is the row's position in the source."""
    return _positioned(_rendered(name, df), "row_key").select("row_key", "text")


_READERS = {
    "ASDiv": read_asdiv_xml,
    "ParaMAWPS": lambda spark, p: read_json_array(spark, p, PARAMAWPS_SCHEMA),
    "SVAMP": lambda spark, p: read_json_array(spark, p, SVAMP_SCHEMA),
    "DMath": read_keyed_json,
    "AQuA": read_aqua_jsonl,
}


def load_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One curriculum source by name -> (row_key, text)."""
    return render_source(name, _READERS[name](spark, path))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a source path exists (file listing happens when a reader is built)."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.format("text").load(path)
        return True
    except AnalysisException:
        return False


def load_curriculum(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """A14 + H1: read the curriculum sources by name -> (dataset, stage, row_key,
    text), the row key being the position in the source.

    A missing source contributes no rows (the reference gives an empty
    dataset); rows whose formatter fails are dropped later by the
    standardiser (C3).
    """
    from mathtide.plans.curriculum import CURRICULUM
    stage = {n: s for n, s, _ in CURRICULUM}
    parts = [_rendered(name, _READERS[name](spark, path)).select(
                 F.lit(name).alias("dataset"), F.lit(stage[name]).alias("stage"), "order_key", "text")
             for name, path in sources.items() if name in _READERS and _exists(spark, path)]
    if not parts:
        return spark.createDataFrame([], "dataset string, stage int, row_key long, text string")
    # one pass positions the rows of all sources, which are read side by side
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return global_rank(every, ["order_key"], "row_key", ["dataset"]).select("dataset", "stage", "row_key", "text")
