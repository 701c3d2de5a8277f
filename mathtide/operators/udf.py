"""User functions over Arrow batches (K1-K3).

These are the only places Python runs per batch: a user's foreign code (an
encoder, a row function, a text generator) is handed pandas frames through
``mapInPandas``.  Everything around them stays built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rebatch(batches: Iterator[pd.DataFrame], size: int | None, whole_batches: bool = False) -> Iterator[pd.DataFrame]:
    """Re-cut Arrow batches into frames of exactly ``size`` rows (the last may be
    short), or with ``whole_batches`` into frames of as many whole ``size`` as a batch holds."""
    if not size:
        yield from batches
        return
    held: pd.DataFrame | None = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        whole = len(pdf) - len(pdf) % size
        if whole and whole_batches:
            yield pdf.iloc[:whole].reset_index(drop=True)
        for at in range(0, 0 if whole_batches else whole, size):
            yield pdf.iloc[at:at + size].reset_index(drop=True)
        held = pdf.iloc[whole:] if whole < len(pdf) else None
    if held is not None:
        yield held.reset_index(drop=True)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
                schema: T.StructType | str, batch_size: int | None = None) -> DataFrame:
    """K1: ``fn`` on column batches of ``batch_size`` rows; it may add or drop columns."""
    def run(batches):
        for pdf in _rebatch(batches, batch_size):
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType | str) -> DataFrame:
    """K2: a row function (dict -> dict) for foreign code; prefer Column expressions."""
    names = (schema if isinstance(schema, T.StructType)
             else df.sparkSession.createDataFrame([], schema).schema).fieldNames()

    def run(batches):
        for pdf in batches:
            rows = [fn(r) for r in pdf.to_dict("records")]
            yield pd.DataFrame.from_records(rows, columns=names) if rows else pd.DataFrame(columns=names)
    return df.mapInPandas(run, schema)


def filter_rows(df: DataFrame, pred: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """K2: keep rows where a vectorised predicate over the batch is true."""
    def run(batches):
        for pdf in batches:
            yield pdf[pred(pdf).fillna(False).astype(bool).to_numpy()]
    return df.mapInPandas(run, df.schema)


def batch_generate(df: DataFrame, generate: Callable[[pd.Series, pd.Series], pd.Series],
                   prompt: str = "prompt", n_votes: int = 1, response: str = "response",
                   vote: str = "vote", batch_size: int | None = None) -> DataFrame:
    """K3: ``n_votes`` responses per prompt from a user generator.

    Rows are repeated with a 0-based vote index (``explode(sequence)``), then
    the generator gets (prompts, votes) batches and returns response texts.  Its
    batches are cut from the Arrow batches' columns; frames leave as large as they came.
    """
    data = df.withColumn(vote, F.explode(F.sequence(F.lit(0), F.lit(n_votes - 1))))
    schema = T.StructType(data.schema.fields + [T.StructField(response, T.StringType(), True)])

    def run(batches):
        for pdf in _rebatch(batches, batch_size, whole_batches=True):
            prompts, votes, size = pdf[prompt], pdf[vote], batch_size or max(len(pdf), 1)
            made: list = []
            for at in range(0, len(pdf), size):
                made.extend(generate(prompts.iloc[at:at + size].reset_index(drop=True),
                                     votes.iloc[at:at + size].reset_index(drop=True)))
            pdf[response] = made
            yield pdf
    return data.mapInPandas(run, schema)
