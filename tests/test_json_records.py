"""JSON arrays and objects read by byte ranges, against Python's parser."""
import json
import os
import random

import pytest

from mathtide.sources import readers as R
from mathtide.sources.json_records import json_records


@pytest.fixture(params=["3000", "17000", "128m"])
def split_bytes(spark, request):
    was = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield request.param
    for c, v in was.items():
        spark.conf.set(c, v)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def records(n, seed=1):
    """Strings full of what could be mistaken for structure."""
    rng = random.Random(seed)
    pool = ["{", "}", "[", "]", '"', "\\", '\\"', "a", "é", "漢", ",", ":", " ", "\n", "x" * 30, "}{", '"}', "]}"]

    def text():
        return "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
    return [{"original_text": f"{text()}{k}", "equation": text(), "ans": k * 1.5,
             "more": {"q": [text(), {"z": text()}, []]}} for k in range(n)]


def test_array(spark, tmp_dir, split_bytes):
    recs = records(1500)
    folder = os.path.join(tmp_dir, "arrays")
    write(f"{folder}/1.json", json.dumps(recs, ensure_ascii=False))
    write(f"{folder}/2.json", "\n " + json.dumps(recs[:50], indent=2) + "\n")
    write(f"{folder}/3.json", " [ ] ")
    df = R.read_json_array(spark, folder, R.PARAMAWPS_SCHEMA)
    got = [(r.original_text, r.equation, r.ans) for r in df.orderBy("order_key").collect()]
    assert got == [(r["original_text"], r["equation"], json.dumps(r["ans"])) for r in recs + recs[:50]]


def test_keyed(spark, tmp_dir, split_bytes):
    keyed = {f"k{k} {r['equation']}": {"question_en": r["original_text"], "solution_code_en": r["equation"], "answer_en": str(k)}
             for k, r in enumerate(records(1500, 2))}
    folder = os.path.join(tmp_dir, "keyed")
    write(f"{folder}/1.json", json.dumps(keyed, ensure_ascii=False))
    write(f"{folder}/2.json", json.dumps(dict(list(keyed.items())[:20]), indent=1) + "\n\n")
    write(f"{folder}/3.json", "{}")
    rows = R.read_keyed_json(spark, folder).orderBy("order_key").collect()
    want = list(keyed.items())
    assert [(r.key, r.question_en, r.solution_code_en, r.answer_en) for r in rows] == [
        (k, v["question_en"], v["solution_code_en"], v["answer_en"]) for k, v in want + want[:20]]


def test_one_file_many_tasks(spark, tmp_dir, split_bytes):
    folder = os.path.join(tmp_dir, "one")
    write(f"{folder}/1.json", json.dumps(records(1500)))
    size = os.path.getsize(f"{folder}/1.json")
    read = spark.read.option("lineSep", "}").text(folder)
    tasks = read.rdd.getNumPartitions()
    assert tasks > 5 or split_bytes == "128m"
    assert size > 100_000 and json_records(spark, folder).count() == 1500


def test_a_record_over_many_splits(spark, tmp_dir, split_bytes):
    recs = [{"original_text": "a"}, {"original_text": "b" * 50_000 + "}" * 500, "more": [{}] * 2000}, {"original_text": "c"}]
    folder = os.path.join(tmp_dir, "long")
    write(f"{folder}/1.json", json.dumps(recs))
    rows = R.read_json_array(spark, folder, R.PARAMAWPS_SCHEMA).orderBy("order_key").collect()
    assert [r.original_text for r in rows] == [r["original_text"] for r in recs]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[{"a": 1}, {"a": "2]', '[{"a": 1}', '{"k": {"a": 1}', '{"k": {"a": 1}, "l": 3',
                                  '[{"a": 1}]]', '{"k": {"a": 1}}}', '[{"a": [1}]'])
def test_malformed_file_is_named(spark, tmp_dir, text):
    folder = os.path.join(tmp_dir, "bad")
    write(f"{folder}/broken.json", text)
    with pytest.raises(Exception, match="broken.json"):
        json_records(spark, folder).collect()
