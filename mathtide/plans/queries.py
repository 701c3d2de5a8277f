"""Registered queries: (spark, sf_dir) -> DataFrame over the driver tables.

Every query reads whole tables (or views Spark derives from them); none uses
id subsets, modulo filters or row caps except where the limit is the operator
itself (a first-n take, a seeded n-sample, a peek of n records).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathtide.functions import answers as A
from mathtide.plans import evaluation as E
from mathtide.plans import views as V


def _r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------ evaluation ---

def vote_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 detail: per (run, question) votes, majority, gold and verdicts."""
    return E.evaluate(V.responses(spark, sf_dir), V.gold(spark, sf_dir), vote="vote_pos")


def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (K4 + E3): accuracy per run after majority voting."""
    acc = E.accuracy_by_run(vote_results(spark, sf_dir), gold=V.gold(spark, sf_dir, rebalance=False))
    return acc.select("run", "n_total", "n_correct", _r6("accuracy").alias("accuracy"))


def first_vote_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 with method 'none': the first vote of every question only."""
    res = E.evaluate(V.responses(spark, sf_dir), V.gold(spark, sf_dir), vote="vote_pos", method="none")
    acc = E.accuracy_by_run(res, gold=V.gold(spark, sf_dir, rebalance=False))
    return acc.select("run", "n_total", "n_correct", _r6("accuracy").alias("accuracy"))


def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + F3: running accuracy per run in question order (skew-safe ranks)."""
    res = vote_results(spark, sf_dir).select("run", "question_id", "correct")
    out = E.running_accuracy_by_run(res)
    return out.select("run", "question_id", "correct", "example_idx", "running_correct",
                      _r6("running_accuracy").alias("running_accuracy"))


def answer_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1-I6 and I2 on every response."""
    r = V.responses(spark, sf_dir)
    t = F.col("response")
    return r.select(
        "run", "question_id", "vote.l_linenumber", "vote.l_partkey", "vote.l_suppkey",
        A.extract_answer(t).alias("extracted"),
        A.extract_answer_plain(t).alias("extracted_plain"),
        A.extract_predicted_answer(t).alias("predicted"),
        A.extract_ground_truth(t).alias("ground_truth"),
        A.extract_keyword_answer(t).alias("keyword_answer"),
        A.clean_number_text(t).alias("cleaned"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I11-I13 and B18 on decoded outputs built from the responses."""
    r = V.responses(spark, sf_dir)
    decoded = F.concat(F.lit("Q: question "), F.col("question_id").cast("string"), F.lit("\nA: "),
                       F.col("response"), F.lit("\n\nQ: next one #### 7\n\nA: 8</s>"))
    chat = F.concat(F.lit("Question: "), F.col("question_id").cast("string"), F.lit("\nAnswer: "),
                    F.col("response"), F.lit("  "))
    kind = F.when(F.col("vote.l_partkey") % 2 == 0, F.lit("qwen")).otherwise(F.lit("gpt2"))
    prompt = F.concat(F.lit("Question: "), F.col("question_id").cast("string"), F.lit("\nAnswer: "))
    return r.select(
        "run", "question_id", "vote.l_linenumber", "vote.l_partkey", "vote.l_suppkey",
        A.post_process_response(decoded).alias("post_processed"),
        A.completion_after_last_a(decoded).alias("after_last_a"),
        A.completion_after_last_a(decoded, cut_at_question=False).alias("after_last_a_uncut"),
        A.cut_at_stop(F.concat(F.col("response"), F.lit(" Q: again"))).alias("cut"),
        A.completion_text(chat, prompt, kind).alias("completion"),
        A.extract_answer(decoded, eos="</s>").alias("extracted_eos"))


def number_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """to_number over every number-like token of the responses and gold texts."""
    r = V.responses(spark, sf_dir)
    tokens = r.select("question_id", "vote.l_linenumber", "vote.l_partkey", "vote.l_suppkey",
                      F.posexplode(F.split(F.col("response"), " ")).alias("pos", "token"))
    parsed = tokens.select("question_id", "l_linenumber", "l_partkey", "l_suppkey", "pos",
                           "token", A.to_number("token").alias("num"))
    return parsed.select("question_id", "l_linenumber", "l_partkey", "l_suppkey", "pos", "token",
                         F.col("num.value").alias("value"), F.col("num.is_whole").alias("is_whole"))


# ------------------------------------------------------------ curriculum ---

def curriculum_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five renderers and their standardisers; failed rows keep nulls (Q1-Q3)."""
    from mathtide.plans import curriculum as C
    rendered = C.render_problems(V.problems(spark, sf_dir))
    return C.standardised(rendered, keep_text=True)


def curriculum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 (+C3): raw and kept rows per dataset and in total."""
    from mathtide.plans import curriculum as C
    return C.dataset_counts(C.render_problems(V.problems(spark, sf_dir)))


def curriculum_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: standardise, drop failures, cap AQuA, SFT prompt, seeded shuffle + 10 % split."""
    from mathtide.plans import curriculum as C
    out = C.prepare(C.render_problems(V.problems(spark, sf_dir)))
    return out.select("dataset", "stage", "row_key", "question", "answer", "prompt", "split", "shuffle_pos")


# -------------------------------------------------------------- sampling ---

def corpus_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full seeded shuffle of the corpus with each row's position."""
    from mathtide.operators import sampling as S
    return S.shuffle(V.corpus(spark, sf_dir).select("doc_id", "lang", "source"), 42, "doc_id")


def corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-size seeded fraction sample of the corpus (5 %)."""
    from mathtide.operators import sampling as S
    return S.sample_fraction(V.corpus(spark, sf_dir).select("doc_id", "lang", "source"), 0.05, 42, "doc_id")


def corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-count 10 % test split per language after a seeded shuffle."""
    from mathtide.operators import sampling as S
    docs = V.corpus(spark, sf_dir).select("doc_id", "lang")
    return S.train_test_split(docs, 0.1, 42, key="doc_id", group="lang")


def corpus_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 documents in key order."""
    from mathtide.operators import sampling as S
    return S.take(V.corpus(spark, sf_dir).select("doc_id", "lang", "source"), 100, ["doc_id"])


def corpus_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document at position 5 in key order."""
    from mathtide.operators import sampling as S
    return S.nth_row(V.corpus(spark, sf_dir).select("doc_id", "lang", "source"), 5, ["doc_id"])


# --------------------------------------------------------------- prompts ---

def few_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11 + B12 + D1: 5 seeded shots before every test question, all styles."""
    from mathtide.operators import sampling as S
    from mathtide.operators import shape as B
    shots = S.sample_n(V.qa_train(spark, sf_dir), 5, 42, "qid", order_col="draw")
    block = B.few_shot_block(shots, ["draw", "qid"]).scalar()
    test = V.qa_test(spark, sf_dir)
    q = F.col("question")
    return test.select(
        "qid",
        B.eval_prompt(q, "question", block).alias("prompt"),
        F.md5(B.eval_prompt(q, "shots_only", block)).alias("shots_only_md5"),
        F.md5(B.eval_prompt(q, "shots_then_question", block)).alias("shots_then_question_md5"),
        F.md5(B.eval_prompt(q, "eight_shot")).alias("eight_shot_md5"),
        F.md5(B.eval_prompt(q, "zero_shot")).alias("zero_shot_md5"),
        F.md5(B.eval_prompt(q, "chat_zero_shot")).alias("chat_zero_shot_md5"),
        F.md5(B.eval_prompt(q, "step_by_step")).alias("step_by_step_md5"),
        B.excerpt(B.eval_prompt(q, "question", block)).alias("prompt_excerpt"))


def instruction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + B9: drop 'data/PoT/' sources, format instruction / response text."""
    from mathtide.operators import filters as C1
    from mathtide.operators import shape as B
    ins = C1.exclude_sources(V.instructions(spark, sf_dir), ["data/PoT/"])
    return ins.select("conv_id", "turn", "source",
                      B.instruction_prompt("instruction", "output").alias("formatted_text"))


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency of every source over the whole instruction table."""
    from mathtide.operators import runlog as R
    return R.source_counts(V.instructions(spark, sf_dir))


def source_counts_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 sampled: source frequency in a peek at the first 1000 records (key order)."""
    from mathtide.operators import runlog as R
    return R.source_counts(V.instructions(spark, sf_dir), sample=1000, order_by=["conv_id", "turn"])


def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one chat prompt with a generation mark."""
    from mathtide.operators import shape as B
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return B.chat_prompt(turns)


# ----------------------------------------------------------- leaderboard ---

def leaderboard_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 (I14-I19, C4, G1, E6, F4, D2): zoomed MATH leaderboard with colours."""
    from mathtide.operators import leaderboard as LB
    out = LB.leaderboard(V.leaderboard(spark, sf_dir))
    return out.select("row_key", "Name", "Family", "Date", "size", "has_size",
                      _r6("size_normalised").alias("size_normalised"), "score", "label", "in_box",
                      "family_idx", "colour")


def leaderboard_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: axis limits of the zoomed view."""
    from mathtide.operators import leaderboard as LB
    typed = LB.prepare(V.leaderboard(spark, sf_dir))
    return LB.axis_bounds(LB.zoom(typed))


def leaderboard_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 + F4: families in first-appearance order with palette index and colour."""
    from mathtide.operators import leaderboard as LB
    return LB.family_palette(LB.prepare(V.leaderboard(spark, sf_dir)))


def leaderboard_size_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family, rows with and without a known size (GSM8K metric)."""
    from mathtide.operators import leaderboard as LB
    typed = LB.prepare(V.leaderboard(spark, sf_dir), metric="GSM8K Performance")
    with_size, without = LB.split_by_size(typed)
    a = with_size.groupBy("Family").agg(F.count(F.lit(1)).alias("n_with_size"))
    b = without.groupBy("Family").agg(F.count(F.lit(1)).alias("n_without_size"))
    return a.join(b, "Family", "full").select(
        "Family", F.coalesce("n_with_size", F.lit(0)).alias("n_with_size"),
        F.coalesce("n_without_size", F.lit(0)).alias("n_without_size"))


def leaderboard_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 variants + E9: zoom sizes for each published threshold, and the empty case."""
    from mathtide.operators import leaderboard as LB
    typed = LB.prepare(V.leaderboard(spark, sf_dir), metric="GSM8K Performance")
    since24 = F.col("Date") >= F.lit("2024-01-01").cast("date")
    since22 = F.col("Date") >= F.lit("2022-01-01").cast("date")

    def n(cond):
        return F.sum(F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)).cast("long")
    out = typed.agg(n(since24 & (F.col("score") >= 40)).alias("n_40"),
                    n(since24 & (F.col("score") >= 70)).alias("n_70"),
                    n(since24 & (F.col("score") >= 75)).alias("n_75"),
                    n(since24 & (F.col("score") >= 79)).alias("n_79"),
                    n(since22).alias("n_since_2022"),
                    n(since24 & (F.col("score") >= 101)).alias("n_101"))
    return out.withColumn("empty_101", F.col("n_101") == 0)


# ---------------------------------------------------------------- runlog ---

def training_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + C6: samples/second and seconds/step every 10 steps per run."""
    from mathtide.operators import runlog as R
    out = R.training_speed(V.step_log(spark, sf_dir))
    return out.select("run", "step", "total_samples", _r6("elapsed_s").alias("elapsed_s"),
                      _r6("samples_per_second").alias("samples_per_second"),
                      _r6("seconds_per_step").alias("seconds_per_step"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total time, steps, steps/second and peak value per run."""
    from mathtide.operators import runlog as R
    out = R.run_summary(V.step_log(spark, sf_dir), memory="value")
    return out.select("run", _r6("total_time_s").alias("total_time_s"), "max_steps", "n_rows",
                      "peak_memory", _r6("steps_per_second").alias("steps_per_second"))


def checkpoint_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 (save form): steps with step % 100 = 0 and step > 0."""
    from mathtide.operators import filters as Fl
    from mathtide.operators import runlog as R
    steps = R.step_index(V.step_log(spark, sf_dir))
    return Fl.every_k_steps(steps, "step", 100, positive=True).select("run", "step", "event_id")


# ---------------------------------------------------------------- tokens ---

def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B13 (fit): corpus vocabulary of 1000 ids, specials first."""
    from mathtide.operators import tokens as T
    return T.fit_vocabulary(V.corpus(spark, sf_dir), "text", 1000)


def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode the whole corpus to 512 padded ids, mask, labels, budget."""
    from mathtide.operators import tokens as T
    from mathtide.operators import shape as B
    docs = B.require_columns(V.corpus(spark, sf_dir), "text").select("doc_id", "text")
    vocab = T.fit_vocabulary(docs, "text", 1000)
    enc = T.encode(docs, vocab, "text", 512, pad=True, n_input_col="__n_full")
    enc = B.prune_columns(enc, "text")
    return enc.select(
        "doc_id",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"),
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join(T.causal_labels(), " ").alias("labels"),
        T.token_budget(F.col("__n_full"), "gpt2", 512).alias("gpt2_new_tokens"),
        T.token_budget(F.col("__n_full"), "deepseek-r1", 2048).alias("deepseek_new_tokens"))


def _bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B13, pre-training form: the corpus as 1024 ids of a public byte-pair
    vocabulary, padded with end-of-text, with causal labels."""
    from mathtide.operators import bpe
    from mathtide.operators import tokens as T
    docs = V.corpus(spark, sf_dir).select("doc_id", "text")
    enc = bpe.encode_bpe(docs, _bpe_path(), n_input_col="n_input")
    return enc.select("doc_id", "n_input", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"),
                      F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
                      F.md5(F.array_join(T.causal_labels(), " ")).alias("labels_md5"))


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the byte-pair vocabulary and decoded."""
    from mathtide.operators import bpe
    docs = V.corpus(spark, sf_dir).select("doc_id", "text")
    ids = bpe.encode_bpe(docs, _bpe_path(), max_length=None, pad=False)
    back = bpe.decode_bpe(ids, _bpe_path())
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


# ------------------------------------------------------------ user code ----

def stub_generator(prompts, votes):
    """Deterministic stand-in for a model: 'The answer is N.' from prompt length."""
    n = prompts.str.len()
    return "The answer is " + ((n + votes) % 50 + 1).astype(str) + "."


def generated_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 + K4: 4 generated votes per gold question, 'The answer is' rule, majority."""
    from mathtide.operators import shape as B
    from mathtide.operators import udf as U
    gold = V.gold(spark, sf_dir)
    prompts = gold.select("question_id", B.eval_prompt(F.col("question"), "zero_shot").alias("prompt"))
    responses = U.batch_generate(prompts, stub_generator, "prompt", n_votes=4, batch_size=64)
    res = E.evaluate(responses, gold, run=None, extractor=A.extract_predicted_answer)
    return res.select("question_id", "n_votes", "majority_answer", "gold_answer", "correct")


def _text_stats(pdf):
    out = pdf[["doc_id", "lang"]].copy()
    out["n_chars"] = pdf["text"].str.len().astype("int64")
    out["n_lines"] = (pdf["text"].str.count("\n") + 1).astype("int64")
    return out


def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K2: vectorised row filter, then a batch function in batches of 64."""
    from mathtide.operators import udf as U
    docs = V.corpus(spark, sf_dir).select("doc_id", "lang", "text")
    kept = U.filter_rows(docs, lambda pdf: pdf["lang"].isin(["en", "de"]))
    return U.map_batches(kept, _text_stats, "doc_id long, lang string, n_chars long, n_lines long", 64)


def _shout(row: dict) -> dict:
    return {"conv_id": row["conv_id"], "turn": row["turn"], "n_words": len((row["text"] or "").split()),
            "loud": (row["role"] or "").upper()}


def row_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 map_rows: a plain function of one record over the whole conversations table."""
    from mathtide.operators import udf as U
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return U.map_rows(turns, _shout, "conv_id long, turn long, n_words long, loud string")


def cut_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B15 cut: unpadded ids of every document cut to the 100 that a budget leaves."""
    from mathtide.operators import tokens as T
    docs = V.corpus(spark, sf_dir).select("doc_id", "text")
    enc = T.encode(docs, T.fit_vocabulary(docs, "text", 1000), "text", 512, pad=False, n_input_col="n_input")
    return enc.select("doc_id", "n_input", F.array_join(T.cut_input("input_ids", 100), " ").alias("cut_ids"))


def repeated_key_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 by a key that repeats: how many lineitems the 5 % sample by order holds
    (exactly 5 % of all), and the least hash left out."""
    from mathtide.operators import sampling as S
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    picked = S.sample_fraction(li, 0.05, 42, "l_orderkey")
    return picked.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("l_orderkey").alias("n_orders"),
                      F.max(S.hash_order(42, "l_orderkey")).alias("last_hash"))


def lineitem_split_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 without positions over lineitem, per line status: rows in the test split
    and the last hash in it."""
    from mathtide.operators import sampling as S
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*key, "l_linestatus")
    out = S.train_test_split(li, 0.1, 42, key=key, group="l_linestatus", positions=False)
    test = F.col("split") == "test"
    return out.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(test).alias("n_test"),
                                           F.max(F.when(test, S.hash_order(42, key))).alias("last_hash"))


# --------------------------------------------------------------- sources ---
# Round trips: a view of the driver tables is written in the source format
# into the shared checkpoint folder and read back with the library reader.

def _scratch(spark: SparkSession, name: str) -> str:
    from mathtide.session import scratch_path
    return scratch_path(spark, name)


def qa_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: train/test JSONL files -> question, answer, split."""
    from pyspark.sql import types as T
    from mathtide.sources import readers as R
    base = _scratch(spark, "qa-jsonl")
    V.qa_train(spark, sf_dir).write.mode("overwrite").json(f"{base}/train")
    V.qa_test(spark, sf_dir).write.mode("overwrite").json(f"{base}/test")
    schema = T.StructType(R.QA_SCHEMA.fields + [T.StructField("qid", T.LongType())])
    train = R.read_qa_jsonl(spark, f"{base}/train", "train", schema)
    test = R.read_qa_jsonl(spark, f"{base}/test", "test", schema)
    return train.unionByName(test).select("qid", "split", "question", "answer")


def _asdiv_fixture(p: DataFrame, some_without_question: bool = True):
    """Problems as ASDiv elements; optional fields absent when empty, and
    (for the C2 check) no Question element on every 17th problem."""
    question = F.col("question")
    if some_without_question:
        question = F.when(F.col("pid") % 17 != 0, question)
    return p.select("pid", F.when(F.col("body") != "", F.col("body")).alias("Body"),
                    question.alias("Question"),
                    F.col("answer").alias("Answer"),
                    F.when(F.col("equation") != "", F.col("equation")).alias("Formula"))


def _in_order(df: DataFrame, key: str = "pid") -> DataFrame:
    """Part files in key order (names sort as the rows do), without the key."""
    return df.orderBy(key).drop(key)


def asdiv_xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + C2 + B1: <Problem> elements (some without Question) -> rendered text."""
    from mathtide.sources import readers as R
    path = _scratch(spark, "asdiv-xml")
    (_in_order(_asdiv_fixture(V.problems(spark, sf_dir))).write.format("xml").option("rowTag", "Problem")
     .option("rootTag", "Machine-Reading-Corpus-File").mode("overwrite").save(path))
    return R.load_source(spark, "ASDiv", path)


def _paramawps_fixture(p: DataFrame, *carry: str):
    return p.select("pid", *carry, F.col("question").alias("original_text"),
                    "equation", (F.col("answer").cast("int")).alias("ans"))


def _svamp_fixture(p: DataFrame, *carry: str):
    return p.select("pid", *carry, F.col("body").alias("Body"),
                    F.col("question").alias("Question"), F.col("equation").alias("Equation"),
                    F.col("answer").cast("int").alias("Answer"))


def _dmath_fixture(p: DataFrame, *carry: str):
    return p.select("pid", *carry, F.col("question").alias("question_en"),
                    F.col("equation").alias("solution_code_en"), F.col("answer").alias("answer_en"))


def _aqua_fixture(p: DataFrame, *carry: str):
    return p.select("pid", *carry, "question", "options", "rationale", "correct")


def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + B2 + B3: JSON-array files (numbers read as text) -> rendered text."""
    from mathtide.sources import readers as R
    from mathtide.sources import writers as W
    base = _scratch(spark, "json-array")
    W.write_json_arrays(_paramawps_fixture(V.problems(spark, sf_dir)), f"{base}/paramawps", "pid")
    W.write_json_arrays(_svamp_fixture(V.problems(spark, sf_dir)), f"{base}/svamp", "pid")
    parts = [R.load_source(spark, n, f"{base}/{n.lower()}").select(F.lit(n).alias("dataset"), "row_key", "text")
             for n in ("ParaMAWPS", "SVAMP")]
    return parts[0].unionByName(parts[1])


def keyed_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + B4: id-keyed JSON objects -> rendered text."""
    from mathtide.sources import readers as R
    from mathtide.sources import writers as W
    path = _scratch(spark, "keyed-json")
    W.write_keyed_json(_dmath_fixture(V.problems(spark, sf_dir)), path, key="pid")
    return R.load_source(spark, "DMath", path)


def aqua_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + B5 + B7: JSONL with option arrays -> rendered and standardised."""
    from mathtide.operators import shape as B
    from mathtide.sources import readers as R
    path = _scratch(spark, "aqua-jsonl")
    _in_order(_aqua_fixture(V.problems(spark, sf_dir))).write.mode("overwrite").json(path)
    df = R.load_source(spark, "AQuA", path).withColumn("__s", B.standardise_aqua(F.col("text")))
    return df.select("row_key", "text", F.col("__s.question").alias("question"), F.col("__s.answer").alias("answer"))


def leaderboard_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + K6: leaderboard written as CSV, read back as text, zoomed view."""
    from mathtide.operators import leaderboard as LB
    from mathtide.sources import readers as R
    path = _scratch(spark, "leaderboard-csv")
    shuffled = ["MATH Performance", "Name", "Published", "Size (in Billion)", "Family", "GSM8K Performance", "row_key"]
    _in_order(V.leaderboard(spark, sf_dir).select(*shuffled), "row_key") \
        .write.mode("overwrite").option("header", True).csv(path)
    out = LB.leaderboard(R.read_leaderboard_csv(spark, path))
    return out.select("row_key", "Name", "Family", "Date", "size", "has_size",
                      _r6("size_normalised").alias("size_normalised"), "score", "label", "in_box",
                      "family_idx", "colour")


def _curriculum_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems written as five source files in five formats and read back."""
    from concurrent.futures import ThreadPoolExecutor
    from mathtide.operators.ranking import global_rank
    from mathtide.sources import readers as R
    from mathtide.sources import writers as W
    base = _scratch(spark, "curriculum")
    # the order of the problems is found once, for the three formats that are cut into files by it
    ranked = global_rank(V.problems(spark, sf_dir), ["pid"], "rank")
    plain = ranked.drop("rank")
    writes = [
        lambda: (_in_order(_asdiv_fixture(plain, some_without_question=False))
                 .write.format("xml").option("rowTag", "Problem").mode("overwrite").save(f"{base}/asdiv")),
        lambda: W.write_json_arrays(_paramawps_fixture(ranked, "rank"), f"{base}/paramawps", "pid", rank="rank"),
        lambda: W.write_json_arrays(_svamp_fixture(ranked, "rank"), f"{base}/svamp", "pid", rank="rank"),
        lambda: W.write_keyed_json(_dmath_fixture(ranked, "rank"), f"{base}/dmath", "pid", rank="rank"),
        lambda: _in_order(_aqua_fixture(plain)).write.mode("overwrite").json(f"{base}/aqua")]
    with ThreadPoolExecutor(len(writes)) as pool:       # independent jobs
        for done in [pool.submit(w) for w in writes]:
            done.result()
    return R.load_curriculum(spark, {
        "ASDiv": f"{base}/asdiv", "ParaMAWPS": f"{base}/paramawps", "SVAMP": f"{base}/svamp",
        "DMath": f"{base}/dmath", "AQuA": f"{base}/aqua"})


def curriculum_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 + H1 + K5: five source files in five formats -> one prepared curriculum."""
    from mathtide.plans import curriculum as C
    out = C.prepare(_curriculum_from_files(spark, sf_dir))
    return out.select("dataset", "stage", "row_key", "question", "answer", "prompt", "split", "shuffle_pos")


def curriculum_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 + E4 on files: records read and records dropped by the formatter, per
    dataset and in total."""
    from mathtide.plans import curriculum as C
    counts = C.dataset_counts(_curriculum_from_files(spark, sf_dir))
    return counts.select("dataset", "n_raw", (F.col("n_raw") - F.col("n_kept")).alias("n_dropped"))


def saved_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + A8: curriculum saved one folder per split; the test split read back."""
    from mathtide.sources import readers as R
    from mathtide.sources import writers as W
    path = _scratch(spark, "splits")
    W.save_splits(curriculum_splits(spark, sf_dir), path, "parquet")
    return R.load_corpus(spark, path, "test").select(
        "dataset", "stage", "row_key", "question", "answer", "prompt", "split", "shuffle_pos")


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: per split rows, columns, types and the first five keys."""
    from mathtide.sources import profile as P
    return P.dataset_profile(corpus_split(spark, sf_dir), "split", "doc_id")


def results_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 + A13: per-question results to CSV and JSON (+ accuracy summary), read back."""
    from mathtide.sources import writers as W
    base = _scratch(spark, "results")
    res = vote_results(spark, sf_dir).select("run", "question_id", "n_votes", "majority_answer",
                                            "gold_answer", "correct")
    W.write_results_csv(res, f"{base}/csv")
    summary = eval_accuracy(spark, sf_dir).withColumn("majority_method", F.lit("all"))
    W.write_results_json(res, summary, f"{base}/json")
    schema = "run string, question_id long, n_votes long, majority_answer double, gold_answer double, correct boolean"
    back = spark.read.option("header", True).schema(schema).csv(f"{base}/csv")
    acc = spark.read.schema("run string, accuracy double").json(f"{base}/json/summary")
    return back.join(acc, "run", "left").select(*res.columns, "accuracy")


def collect_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (run, question) the response texts and numbers in vote order, in
    records of at most four votes."""
    from mathtide.operators import voting as VT
    r = V.responses(spark, sf_dir).withColumn("numeric", A.extract_answer("response"))
    out = VT.collect_votes(r, ["run", "question_id"], "vote", ["response", "numeric"],
                           chunk_size=4)
    return out.select("run", "question_id", "chunk",
                      F.array_join("responses", " | ").alias("model_answers_text"),
                      F.array_join(F.transform("numerics", lambda x: F.coalesce(x.cast("string"), F.lit("null"))),
                                   ",").alias("extracted_model_answers"))


def dataset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset names joined to their kept counts by name (not by position)."""
    from mathtide.plans import curriculum as C
    names = spark.createDataFrame([(n, s) for n, s, _ in C.CURRICULUM], "dataset string, stage int")
    counts = C.dataset_counts(C.render_problems(V.problems(spark, sf_dir))).where(F.col("dataset").isNotNull())
    return names.join(counts, "dataset", "left").select("dataset", "stage", "n_kept")


# ------------------------------------------------------------- streaming ---

def stream_corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + J1: corpus stream, sources 'src1*' excluded, token counts and prompts."""
    from mathtide.operators import shape as B
    from mathtide.operators import tokens as T
    from mathtide.streaming import jobs as J
    stream = J.table_stream(spark, f"{sf_dir}/documents.parquet")

    def project(df):
        return df.select("doc_id", "source", F.size(T.tokens("text")).alias("n_tokens"),
                         F.md5(B.instruction_prompt("lang", "text")).alias("prompt_md5"))
    return J.run_to_table(J.stream_filter_map(stream, ["src1"], "source", project), "j1")


def stream_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded shuffle of the corpus stream through a buffer of 64 records that
    is refilled record by record; the corpus arrives in several micro-batches."""
    from mathtide.streaming import carried
    stream = _staged(spark, sf_dir, "documents", ["doc_id", "lang"], ["doc_id"], position="position")
    out = carried.buffer_shuffle(stream, "position", buffer_size=64, seed=42)
    return out.select("doc_id", "lang", "position", "shuffle_pos")


def stream_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 records of the corpus stream."""
    from mathtide.streaming import jobs as J
    stream = J.table_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return J.run_head(stream, 100, "j3", ["doc_id"])


def stream_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-source counts over the corpus stream."""
    from mathtide.streaming import jobs as J
    stream = J.table_stream(spark, f"{sf_dir}/documents.parquet")
    return J.run_to_table(J.stream_source_counts(stream), "j4", mode="update", keys=["source"])


def stream_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run response accuracy over the lineitem stream joined to static gold."""
    from mathtide.streaming import jobs as J
    raw = J.table_stream(spark, f"{sf_dir}/lineitem.parquet").select(*V._LINEITEM_COLUMNS)
    stream = V.responses_from(J.spread_stream(raw, f"{sf_dir}/lineitem.parquet"))
    out = J.run_to_table(J.stream_accuracy(stream, V.gold(spark, sf_dir, rebalance=False)), "j5",
                         mode="update", keys=["run"])
    return out.select("run", "n_total", "n_correct",
                      _r6(F.col("n_correct") / F.col("n_total")).alias("accuracy"))


def stream_training_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run steps, samples and samples/second over the event stream."""
    from mathtide.streaming import jobs as J
    stream = V.step_log_from(J.table_stream(spark, f"{sf_dir}/events.parquet"))
    out = J.run_to_table(J.stream_training_speed(stream), "j6", mode="update", keys=["run"])
    elapsed = F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts")) / F.lit(1e6)
    return out.select("run", "n_steps", "total_samples", _r6(elapsed).alias("elapsed_s"),
                      _r6(F.when(elapsed > 0, F.col("total_samples") / elapsed)).alias("samples_per_second"))


def eight_shot_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, 8-shot form: decoded text = fixed 8-shot prompt + generation; the
    completion after the last 'A:' cut at 'Q:' (I12), 'The answer is' rule with
    fallback (I4), maj@8 over the first 8 votes, gold by I1, accuracy per run."""
    from mathtide.operators import shape as B
    r = V.responses(spark, sf_dir)
    question = F.concat(F.lit("How much is order "), F.col("question_id").cast("string"), F.lit("?"))
    decoded = F.concat(B.eval_prompt(question, "eight_shot"), F.lit(" "), F.col("response"),
                       F.lit("\n\nQ: next question"))
    res = E.evaluate(r.withColumn("decoded", decoded), V.gold(spark, sf_dir), response="decoded",
                     vote="vote_pos", extractor=A.extract_predicted_answer, method="maj@8",
                     cut=A.completion_after_last_a)
    acc = E.accuracy_by_run(res, gold=V.gold(spark, sf_dir, rebalance=False))
    return acc.select("run", "n_total", "n_correct", _r6("accuracy").alias("accuracy"))


def corpus_split_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 without positions: the exact 10 % test split per language decided by
    hash digits (aggregates over keys only; rows are never shuffled)."""
    from mathtide.operators import sampling as S
    docs = V.corpus(spark, sf_dir).select("doc_id", "lang")
    return S.train_test_split(docs, 0.1, 42, key="doc_id", group="lang", positions=False)


def multiple_choice_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12 multiple-choice style over every problem's options."""
    from mathtide.operators import shape as B
    p = V.problems(spark, sf_dir)
    return p.select("pid", B.eval_prompt(B.py_strip("question"), "multiple_choice",
                                         options=F.col("options")).alias("prompt"))


def stream_source_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 peek form: source counts over the first 400 records of the stream (J3 then count)."""
    from mathtide.streaming import jobs as J
    stream = J.table_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "source")
    head = J.run_head(stream, 400, "j4peek", ["doc_id"])
    return head.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def curriculum_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 last step: the curriculum prompts tokenised to at most 512 ids, unpadded
    (vocabulary of 1000 fitted on the prompts)."""
    from mathtide.operators import tokens as T
    from mathtide.plans import curriculum as C
    # the vocabulary and the encoding both read the prompts
    out = C.prepare(C.render_problems(V.problems(spark, sf_dir))).select(
        "dataset", "row_key", "split", "prompt").checkpoint()
    vocab = T.fit_vocabulary(out, "prompt", 1000)
    enc = T.encode(out, vocab, "prompt", 512, pad=False, n_input_col="n_input")
    return enc.select("dataset", "row_key", "split", F.size("input_ids").alias("n_tokens"),
                      F.array_join("input_ids", " ").alias("input_ids"), "n_input")


def stream_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 pre-training form: the corpus stream encoded to 1024 padded ids with
    causal labels (vocabulary of 1000 fitted on the corpus table)."""
    from mathtide.operators import tokens as T
    from mathtide.streaming import jobs as J
    vocab = T.fit_vocabulary(V.corpus(spark, sf_dir), "text", 1000)
    stream = J.table_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    enc = T.encode(J.spread_stream(stream, f"{sf_dir}/documents.parquet"), vocab, "text", 1024, pad=True)
    out = enc.select("doc_id", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"),
                     F.array_join("input_ids", " ").alias("input_ids"),
                     F.array_join(T.causal_labels(), " ").alias("labels"))
    return J.run_to_table(out, "jtok")


def parquet_footer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and rows of three tables, counted without reading a column."""
    from mathtide.sources import profile as P
    parts = [P.parquet_stats(spark, f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table"), "num_rows")
             for t in ("documents", "lineitem", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def parquet_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups of three tables from their footers, and the rows they hold."""
    from mathtide.sources import profile as P
    parts = [P.row_groups(spark, f"{sf_dir}/{t}.parquet").agg(
        F.lit(t).alias("table"), F.sum("num_rows").alias("num_rows"), (F.count(F.lit(1)) > 0).alias("has_row_groups"))
        for t in ("documents", "lineitem", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _staged(spark: SparkSession, sf_dir: str, name: str, columns: list[str], order: list[str],
            position: str | None = None) -> DataFrame:
    """A whole table as a stream of three micro-batches in the given order, each of
    at least a file per core."""
    from mathtide.streaming import jobs as J
    path = _scratch(spark, f"staged-{name}")
    files = J.stage_in_order(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns), order, path, position,
                             least_files=3 * spark.sparkContext.defaultParallelism)
    return J.file_stream(spark, path, max_files_per_trigger=max(1, -(-files // 3)))


def stream_running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 per example: running accuracy after every response of the lineitem
    stream (judged against static gold), carried across micro-batches by Spark's
    state store: the table arrives in question order."""
    from mathtide.streaming import carried
    from mathtide.streaming import jobs as J
    raw = carried.placed(_staged(spark, sf_dir, "lineitem", V._LINEITEM_COLUMNS,
                                 ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]))
    # the answer is a column of its own below the join: in the verdict it would be extracted for each use
    resp = V.responses_from(raw, *carried.PLACE).withColumn("response", A.extract_answer("response"))
    gold = V.gold(spark, sf_dir, rebalance=False).select(
        "question_id", A.extract_answer("answer").alias("gold_answer")).checkpoint()
    judged = resp.join(gold, "question_id", "left").select(
        "run", "question_id", "vote.l_linenumber", "vote.l_partkey", "vote.l_suppkey", *carried.PLACE,
        A.is_correct("response", "gold_answer").alias("correct"))
    out = J.stream_running_accuracy(judged)
    return out.select("run", "question_id", "l_linenumber", "l_partkey", "l_suppkey", "correct",
                      "example_idx", "running_correct", _r6("running_accuracy").alias("running_accuracy"))


def stream_training_speed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 every 10 steps: the step log as a stream in time order, speed metrics
    carried across micro-batches by Spark's state store."""
    from mathtide.streaming import carried
    from mathtide.streaming import jobs as J
    log = V.step_log_from(carried.placed(_staged(spark, sf_dir, "events", ["event_type", "event_id", "ts", "value"],
                                                 ["ts", "event_id"])), *carried.PLACE)
    out = J.stream_speed_steps(log)
    return out.select("run", "step", "total_samples", _r6("elapsed_s").alias("elapsed_s"),
                      _r6("samples_per_second").alias("samples_per_second"),
                      _r6("seconds_per_step").alias("seconds_per_step"))
