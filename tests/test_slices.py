"""Slice counts follow the data, not the estimates that joins multiply."""

from pyspark.sql import functions as F

from mathtide.operators import sampling as S
from mathtide.operators.ranking import global_rank, input_slices
from mathtide.session import checkpoint_dir


def _joined(spark, times):
    """A few rows whose estimated size is a product of many sizes."""
    checkpoint_dir(spark)
    df = spark.range(0, 40, numPartitions=2).checkpoint()
    for k in range(times):
        other = spark.range(0, 40, numPartitions=2).select("id", F.repeat(F.lit("x"), 10).alias(f"c{k}"))
        df = df.hint("merge").join(other, "id")
    return df.checkpoint()


def test_slices_of_a_checkpoint_follow_its_partitions(spark):
    for times in (3, 4, 5, 9):
        df = _joined(spark, times)
        assert input_slices(df, 1) <= df.rdd.getNumPartitions()


def test_rank_and_sample_of_a_joined_checkpoint(spark):
    df = _joined(spark, 5)
    assert sorted(r.at for r in global_rank(df, ["id"], "at").collect()) == list(range(40))
    assert S.sample_fraction(df, 0.25, 3, "id").count() == 10
    assert S.train_test_split(df, 0.25, 3, "id", positions=False).where("split = 'test'").count() == 10
