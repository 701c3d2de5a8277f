"""Streams over tables that are folders of part files give the rows of the same tables as files."""

import os

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables, the streamed ones as folders of three part files."""
    base = str(tmp_path_factory.mktemp("folders"))
    for name in os.listdir(SF_SMALL):
        if name in ("documents.parquet", "lineitem.parquet", "events.parquet"):
            spark.read.parquet(f"{SF_SMALL}/{name}").repartition(3).write.parquet(f"{base}/{name}")
        else:
            os.symlink(f"{SF_SMALL}/{name}", f"{base}/{name}")
    return base


@pytest.mark.parametrize("name", ["stream_corpus_filter", "stream_head", "stream_source_counts", "stream_source_peek",
                                  "stream_tokenise", "stream_accuracy", "stream_training_speed"])
def test_stream_over_a_folder(spark, folders, name):
    query = E.queries()[name]
    got, want = query(spark, folders), query(spark, SF_SMALL)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
