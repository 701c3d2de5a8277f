"""Split, shuffle and samples: exact sizes, permutations, seed stability."""

import math

from pyspark.sql import functions as F

from mathtide.operators import sampling as S


def test_split_exact_disjoint_complete(spark):
    df = spark.range(0, 1234).withColumn("g", F.col("id") % 3)
    out = S.train_test_split(df, 0.1, 42, key="id", group="g").cache()
    assert out.count() == 1234
    assert out.select("id").distinct().count() == 1234
    for r in out.groupBy("g").agg(F.count("*").alias("n"),
                                  F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("t")).collect():
        assert r.t == math.ceil(0.1 * r.n)


def test_shuffle_is_permutation_and_seeded(spark):
    df = spark.range(0, 500)
    a = S.shuffle(df, 7, "id").toPandas().sort_values("shuffle_pos")
    b = S.shuffle(df.repartition(9), 7, "id").toPandas().sort_values("shuffle_pos")
    assert sorted(a["shuffle_pos"]) == list(range(500))
    assert list(a["id"]) == list(b["id"])
    c = S.shuffle(df, 8, "id").toPandas().sort_values("shuffle_pos")
    assert list(a["id"]) != list(c["id"])


def test_sample_sizes(spark):
    df = spark.range(0, 300)
    assert S.sample_n(df, 10, 1, "id").count() == 10
    assert S.sample_n(df, 1000, 1, "id").count() == 300
    assert S.sample_fraction(df, 0.05, 1, "id").count() == 15
    a = sorted(r.id for r in S.sample_n(df, 10, 1, "id").collect())
    b = sorted(r.id for r in S.sample_n(df.repartition(5), 10, 1, "id").collect())
    assert a == b


def test_take_per_group_and_nth(spark):
    df = spark.range(0, 100).withColumn("g", F.col("id") % 2)
    out = S.take_per_group(df, 3, "g", ["id"]).collect()
    assert sorted(r.id for r in out) == [0, 1, 2, 3, 4, 5]
    assert S.nth_row(df, 5, ["id"]).first().id == 5


def test_sample_uses_take_ordered(spark):
    plan = S.sample_n(spark.range(0, 50), 5, 1, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_hash_selection_matches_ranking(spark):
    df = spark.range(0, 5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.when(F.col("id") % 7 == 0, None).otherwise("cold")))
    fast = S.train_test_split(df, 0.1, 5, key="id", group="g", positions=False)
    slow = S.train_test_split(df, 0.1, 5, key="id", group="g", positions=True)
    a = sorted((r.id, r.split) for r in fast.collect())
    b = sorted((r.id, r.split) for r in slow.collect())
    assert a == b
    got = S.sample_fraction(df, 0.03, 9, "id")
    want = S.shuffle(df, 9, "id").where(F.col("shuffle_pos") < 150)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_first_n_by_key_matches_ranking(spark):
    df = spark.range(-2000, 3000).withColumn("g", (F.abs(F.col("id")) % 4).cast("string"))
    got = sorted(r.id for r in S.take_per_group(df, 77, "g", ["id"]).collect())
    want = sorted(r.id for r in S.running_totals(df, ["id"], ["g"], rank_col="p").where("p < 77").collect())
    assert got == want and len(got) == 4 * 77


def test_repeated_and_null_keys_give_exact_sizes(spark):
    """Keys in pairs, one key of a third of all rows, null keys, equal rows."""
    pairs = spark.range(0, 2000).withColumn("k", F.floor(F.col("id") / 2))
    hot = spark.range(0, 3000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")))
    nulls = spark.range(0, 900).withColumn("k", F.when(F.col("id") % 2 == 0, F.col("id")))
    equal = spark.range(0, 500).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    for df in (pairs, hot, nulls, equal):
        n = df.count()
        for fraction in (0.0, 0.15, 0.5, 1.0):
            assert S.sample_fraction(df, fraction, 3, "k").count() == int(n * fraction)
        one = sorted(map(str, S.sample_fraction(df, 0.15, 3, "k").collect()))
        two = sorted(map(str, S.sample_fraction(df.repartition(11), 0.15, 3, "k").collect()))
        assert one == two
        assert sorted(map(str, S.sample_n(df, 101, 3, "k").collect())) == \
            sorted(map(str, S.sample_n(df.repartition(7), 101, 3, "k").collect()))
    first = S.take_per_group(nulls.withColumn("g", F.lit(1)), 50, "g", ["k"]).collect()
    assert len(first) == 50 and all(r.k is None for r in first)


def test_large_samples_are_the_same_rows(spark, monkeypatch):
    df = spark.range(0, 4000).withColumn("k", F.floor(F.col("id") / 2))
    small = sorted(r.id for r in S.sample_n(df, 333, 5, "k").collect())
    monkeypatch.setattr(S, "MERGED_SAMPLE", 10)
    assert sorted(r.id for r in S.sample_n(df, 333, 5, "k").collect()) == small


def test_many_groups(spark):
    df = spark.range(0, 24_000).withColumn("g", F.col("id") % 12_000)
    out = S.train_test_split(df, 0.5, 1, key="id", group="g", positions=False)
    assert out.where("split = 'test'").count() == 12_000


def test_draws_do_not_depend_on_folder_or_splits(spark, tmp_dir):
    from mathtide import api
    rows = spark.createDataFrame([(f"q{i}", f"#### {i}") for i in range(400)], "question string, answer string")
    rows.coalesce(1).write.json(f"{tmp_dir}/a")
    rows.repartition(9).write.json(f"{tmp_dir}/b")
    def draw(folder):
        return sorted(r.question for r in api.load_gsm8k(spark, folder, folder, 25)[1].collect())
    one, block = draw(f"{tmp_dir}/a"), api.create_cot_prompt(spark.read.json(f"{tmp_dir}/a")).first()[0]
    assert draw(f"{tmp_dir}/b") == one and api.create_cot_prompt(spark.read.json(f"{tmp_dir}/b")).first()[0] == block
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        assert draw(f"{tmp_dir}/a") == one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_selection_edge_cases(spark):
    df = spark.range(0, 50)
    assert S.sample_fraction(df, 0.0, 1, "id").count() == 0
    assert S.sample_fraction(df, 1.0, 1, "id").count() == 50
    assert S.sample_fraction(df.where("id < 0"), 0.5, 1, "id").count() == 0
    tiny = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, g string")
    split = {r.id: r.split for r in S.train_test_split(tiny, 0.1, 7, "id", "g", positions=False).collect()}
    assert split[1] == "test" and sorted(split[i] for i in (2, 3)) == ["test", "train"]
