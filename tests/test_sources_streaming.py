"""Readers and writers on small files, streaming = batch."""

import os

import pytest
from pyspark.sql import functions as F

from mathtide.sources import readers as R
from mathtide.sources import writers as W
from mathtide.sources import profile as P

XML = """<?xml version="1.0"?>
<Machine-Reading-Corpus-File><ProblemSet>
  <Problem ID="a"><Body> Ann has 3. </Body><Question>How many?</Question><Answer>3</Answer><Formula>3</Formula></Problem>
  <Group><Problem ID="b"><Question>Q2</Question><Answer>4</Answer></Problem></Group>
  <Problem ID="c"><Body>no question</Body><Answer>1</Answer></Problem>
</ProblemSet></Machine-Reading-Corpus-File>"""


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_asdiv_xml_any_depth(spark, tmp_dir):
    p = os.path.join(tmp_dir, "asdiv", "a.xml")
    _write(p, XML.replace('ID="', '_id_unused="'))
    df = R.read_asdiv_xml(spark, os.path.dirname(p))
    rows = sorted((r.question, r.body, r.formula) for r in df.collect())
    assert rows == [("How many?", "Ann has 3.", "3"), ("Q2", "", "")]


def test_json_array_numbers_as_text(spark, tmp_dir):
    p = os.path.join(tmp_dir, "pm", "a.json")
    _write(p, '[{"id": "1", "original_text": " q ", "equation": "x=1", "ans": 5.0},'
              ' {"id": "2", "original_text": "r", "ans": 7}]')
    df = R.read_json_array(spark, os.path.dirname(p), R.PARAMAWPS_SCHEMA)
    rows = sorted((r.order_key.pos, r.original_text, r.equation, r.ans) for r in df.collect())
    assert rows == [(0, " q ", "x=1", "5.0"), (1, "r", None, "7")]


def test_keyed_json(spark, tmp_dir):
    p = os.path.join(tmp_dir, "dm", "a.json")
    _write(p, '{"k1": {"question_en": "q", "solution_code_en": "s", "answer_en": "1"},'
              ' "k2": {"question_en": "q2", "answer_en": "2"}}')
    rows = sorted((r.key, r.answer_en) for r in R.read_keyed_json(spark, os.path.dirname(p)).collect())
    assert rows == [("k1", "1"), ("k2", "2")]


def test_missing_source_is_empty(spark, tmp_dir):
    p = os.path.join(tmp_dir, "aq", "a.jsonl")
    _write(p, '{"id": "1", "question": "Q", "options": ["1"], "rationale": "r", "correct": "A"}\n')
    df = R.load_curriculum(spark, {"AQuA": os.path.dirname(p), "SVAMP": os.path.join(tmp_dir, "nope")})
    assert [r.dataset for r in df.collect()] == ["AQuA"]
    assert R.load_curriculum(spark, {"SVAMP": os.path.join(tmp_dir, "nope")}).count() == 0


def test_save_splits_formats(spark, tmp_dir):
    df = spark.createDataFrame([(1, "train", [1, 2]), (2, "test", [3])], "k int, split string, ids array<int>")
    for fmt in ("parquet", "json", "csv"):
        W.save_splits(df, os.path.join(tmp_dir, fmt), fmt)
    assert R.load_corpus(spark, os.path.join(tmp_dir, "parquet"), "test").count() == 1
    with pytest.raises(ValueError):
        W.save_splits(df, os.path.join(tmp_dir, "x"), "arrow")


def test_parquet_stats(spark, tmp_dir):
    spark.range(0, 1000).repartition(3).write.parquet(os.path.join(tmp_dir, "pq"))
    r = P.parquet_stats(spark, os.path.join(tmp_dir, "pq")).first()
    assert (r.num_files, r.num_rows) == (3, 1000) and r.size_text.endswith("MB")


def test_row_groups(spark, tmp_dir):
    import pyarrow as pa
    import pyarrow.parquet as pq
    folder = os.path.join(tmp_dir, "groups of rows")
    os.makedirs(folder)
    want = set()
    for name, size, rows in (("a", 10, 95), ("b", 1000, 50), ("c", 7, 7)):
        pq.write_table(pa.table({"x": list(range(rows))}), f"{folder}/{name}.parquet", row_group_size=size)
        want |= {(name, k, min(size, rows - k * size)) for k in range(-(-rows // size))}
    got = P.row_groups(spark, folder).collect()
    assert {(r.file.split("/")[-1].split(".")[0], r.row_group, r.num_rows) for r in got} == want
    r = P.parquet_stats(spark, folder, groups=True).first()
    assert (r.num_files, r.num_rows, r.num_row_groups) == (3, 152, 12)


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    q = E.queries()
    for name in ("stream_source_counts", "stream_accuracy"):
        assert q[name](spark, sf).count() > 0
    stream = {r.source: r.n for r in q["stream_source_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    batch = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    assert stream == batch


def test_multi_batch_stream_equals_batch(spark, tmp_dir):
    from mathtide.streaming import jobs as J
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang")
    folder = os.path.join(tmp_dir, "docs")
    docs.repartition(3, "doc_id").write.parquet(folder)          # three files -> three micro-batches
    stream = J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=1)
    counts = J.run_to_table(J.stream_source_counts(stream), "t-counts", mode="complete")
    want = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    assert {r.source: r.n for r in counts.collect()} == want
    nullable = F.when(F.col("source") != "src3", F.col("source")).alias("source")
    changed = J.run_to_table(J.stream_source_counts(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=1).select(nullable)),
                             "t-update", mode="update", keys=["source"])
    assert {r.source or "src3": r.n for r in changed.collect()} == want
    kept = J.run_to_table(J.stream_filter_map(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=1), ["src1"], "source",
                                              lambda d: d.select("doc_id")), "t-filter")
    expected = docs.where(~F.col("source").startswith("src1")).select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in expected.collect())


def test_jsonl_line_order_across_splits(spark, tmp_dir):
    p = os.path.join(tmp_dir, "big", "a.jsonl")
    _write(p, "".join('{"question": "q%06d", "answer": "a"}\n' % i for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")          # many splits of one file
    try:
        df = R.read_qa_jsonl(spark, os.path.dirname(p))
        assert df.rdd.getNumPartitions() > 3
        got = [r.question for r in df.orderBy("order_key").select("question").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == ["q%06d" % i for i in range(20000)]


def test_result_names():
    assert W.single_results_name("gpt2", 4) == "gpt2_gsm8k_4shot_results.csv"
    assert W.vote_results_name("org/model-7b", True, 8, 0.7) == "model-7b_maj1@8_temp0.7_results.json"
    assert W.vote_results_name("org/model-7b", False, 8, 0.7) == "model-7b_results.json"
