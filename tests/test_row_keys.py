"""Row keys of sources without ids: the position in the source."""

import json
import os

from mathtide.plans import curriculum as C
from mathtide.sources import readers as R


def _aqua(folder, n, files=3):
    os.makedirs(folder)
    per = -(-n // files)
    for f in range(files):
        with open(os.path.join(folder, f"part-{f}.jsonl"), "w") as out:
            for i in range(f * per, min(n, (f + 1) * per)):
                out.write(json.dumps({"question": f"Q{i}", "options": ["1", "2"], "rationale": "r", "correct": "A"}) + "\n")


def test_positions_are_list_order_at_any_split(spark, tmp_dir):
    _aqua(f"{tmp_dir}/aq", 400)
    want = [(i, f"Q{i}") for i in range(400)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = R.load_source(spark, "AQuA", f"{tmp_dir}/aq").collect()
            assert sorted((r.row_key, r.text.split("\n")[0].removeprefix("Question: ")) for r in rows) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_without_ids_are_shuffled_and_capped_in_list_order(spark, tmp_dir):
    _aqua(f"{tmp_dir}/aq", 300)
    rows = C.prepare(R.load_curriculum(spark, {"AQuA": f"{tmp_dir}/aq"}), caps={"AQuA": 200}).collect()
    assert sorted(r.row_key for r in rows) == list(range(200))
    by_place = [r.row_key for r in sorted(rows, key=lambda r: r.shuffle_pos)]
    assert sorted(r.shuffle_pos for r in rows) == list(range(200)) and by_place != list(range(200))
    assert sorted(r.row_key for r in rows if r.split == "test") != list(range(20))


def test_leaderboard_csv_in_any_column_order(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write("Family,Name,MATH Performance,Published,GSM8K Performance,Size (in Billion)\nF,M,50,24-Mar,60,7\nF,N,,24-Apr,,\n")
    rows = R.read_leaderboard_csv(spark, f"{tmp_dir}/a.csv").orderBy("row_key").collect()
    assert [(r.row_key, r.Name, r["Size (in Billion)"], r["MATH Performance"]) for r in rows] == \
        [(0, "M", "7", "50"), (1, "N", None, None)]


def test_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    import pytest
    from mathtide import session

    class Context:
        master = "yarn"
        def getCheckpointDir(self): return None
        def getConf(self): return {}

    class Session:
        sparkContext = Context()
        class conf:
            @staticmethod
            def get(*_): return None
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_vocabulary_fit_reads_the_corpus_once(spark):
    from mathtide.operators import tokens as T
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    docs = spark.createDataFrame([(f"w{i % 7} x",) for i in range(500)], "text string").mapInArrow(count, "text string")
    assert T.fit_vocabulary(docs, "text", 6).count() == 3
    assert seen.value == 500
