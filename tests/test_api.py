"""Task-level entry points over small files."""

import os

from pyspark.sql import functions as F

from mathtide import api


def test_gsm8k_flow(spark, tmp_dir):
    train = spark.createDataFrame([(f"q{i}", f"step {i} #### {i}") for i in range(20)], "question string, answer string")
    test = spark.createDataFrame([(f"t{i}", f"#### {i % 3}") for i in range(10)], "question string, answer string")
    train.write.json(os.path.join(tmp_dir, "train"))
    test.write.json(os.path.join(tmp_dir, "test"))
    tr, te = api.load_gsm8k(spark, os.path.join(tmp_dir, "train"), os.path.join(tmp_dir, "test"), num_samples=4)
    assert tr.count() == 20 and te.count() == 4
    prompts = api.create_five_shot_prompt(tr, te)
    first = prompts.first().prompt
    assert first.count("Question: ") == 6 and first.endswith("after ####.\n")
    te_keyed = te.withColumn("question_id", F.monotonically_increasing_id()).cache()
    responses = te_keyed.select("question_id", F.lit("r").alias("run"), F.lit(0).alias("vote"),
                                F.col("answer").alias("response"))
    results, acc = api.evaluate_model(responses, te_keyed.select("question_id", "answer"), "none")
    assert acc.first().accuracy == 1.0 and results.count() == 4


def test_curriculum_and_openwebmath(spark, tmp_dir):
    p = os.path.join(tmp_dir, "aq")
    spark.createDataFrame([(str(i), f"Q{i}", ["1", "2"], "r", "A") for i in range(5)],
                          "id string, question string, options array<string>, rationale string, correct string") \
        .write.json(p)
    cl = api.get_cl_learning_data(spark, {"AQuA": p, "ASDiv": os.path.join(tmp_dir, "missing")})
    assert cl.count() == 5 and api.prepare_datasets_qa(cl).where(F.col("prompt").startswith("###Question: ")).count() == 5
    corpus = spark.range(0, 3000).withColumn("url", F.concat(F.lit("u"), F.col("id").cast("string")))
    assert api.load_and_prepare_openwebmath(corpus, 0.001).count() == 3


def test_loaders_and_helpers_smoke(spark, tmp_dir):
    import datetime as dt

    def write(name, text):
        path = os.path.join(tmp_dir, name, "f.json")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
        return os.path.dirname(path)

    asdiv = write("asdiv", "<R><Problem ID='1'><Question>Q?</Question><Answer>2</Answer></Problem></R>")
    assert api.load_asdiv_data(spark, asdiv).first().text == "Question: Q?\nAnswer: 2"
    pm = write("pm", '[{"id": "1", "original_text": "q", "equation": "e", "ans": 3}]')
    assert api.load_paramawps_data(spark, pm).first().text == "Question: q\nEquation: e\nAnswer: 3"
    sv = write("sv", '[{"ID": "1", "Body": "b", "Question": "q", "Equation": "", "Answer": 4}]')
    assert api.load_svamp_data(spark, sv).first().text == "Question: b q\nAnswer: 4"
    dm = write("dm", '{"7": {"question_en": "q", "solution_code_en": "s", "answer_en": "5"}}')
    assert api.load_dmath_data(spark, dm).first().text == "Question: q\nSolution: s\nAnswer: 5"
    aq = write("aq", '{"id": "1", "question": "q", "options": ["x"], "rationale": "r", "correct": "A"}\n')
    assert api.load_aqua_data(spark, aq).first().text == "Question: q\nOptions:\nA. x\nRationale: r\nAnswer: A"
    ins = spark.createDataFrame([("i", "o", "data/PoT/x"), ("j", "p", "data/CoT/y")], "instruction string, output string, source string")
    kept = api.exclude_sources_by_prefix(ins, ["data/PoT/"])
    assert api.prepare_instruction_data(kept).first().formatted_text == "Instruction\nj\nResponse\np"
    docs = spark.createDataFrame([(1, "a b a")], "id long, text string")
    from mathtide.operators import tokens as T
    assert api.tokenize_function(docs, T.fit_vocabulary(docs, "text", 10), "text", 4).first().input_ids == [3, 4, 3, 0]
    api.save_dataset_to_disk(ins.withColumn("split", ins.source), os.path.join(tmp_dir, "saved"))
    assert api.count_samples(spark, os.path.join(tmp_dir, "saved")).first().num_rows == 2
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("r", i, t0 + dt.timedelta(seconds=i), 2, 1) for i in range(10)],
                                "run string, event_id long, ts timestamp_ntz, batch int, accumulation int")
    assert api.training_speed(log).first().total_samples == 20
    assert api.run_summary(log).first().max_steps == 10
