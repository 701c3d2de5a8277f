"""Entry points by task, one per callable of the reference's surface.

Each is a DataFrame-in / DataFrame-out form of the same job, built from the
operators of this package; where the reference returned Python lists or a
float, these return DataFrames (one row for a scalar) so that nothing has to
pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from mathtide.functions import answers as A
from mathtide.operators import filters as C
from mathtide.operators import runlog as R
from mathtide.operators import sampling as S
from mathtide.operators import shape as B
from mathtide.operators import tokens as T
from mathtide.plans import curriculum as CU
from mathtide.plans import evaluation as EV
from mathtide.sources import profile as P
from mathtide.sources import readers as RD
from mathtide.sources import writers as W

#: draws go by the record itself: a file position would change with the folder
CONTENT = ("question", "answer")

# ------------------------------------------------------------------ load ---


def load_gsm8k(spark: SparkSession, train_path: str, test_path: str, num_samples: int | None = None,
               seed: int = 42, key: Sequence[str] = CONTENT) -> tuple[DataFrame, DataFrame]:
    """Train and test question/answer tables; optionally a seeded sample of
    ``min(num_samples, size)`` test rows, drawn by the record's content, so the
    same records give the same sample from any folder and at any split size."""
    train = RD.read_qa_jsonl(spark, train_path, "train")
    test = RD.read_qa_jsonl(spark, test_path, "test")
    if num_samples:
        test = S.sample_n(test, num_samples, seed, key)
    return train, test


def load_asdiv_data(spark: SparkSession, path: str) -> DataFrame:
    return RD.load_source(spark, "ASDiv", path)


def load_paramawps_data(spark: SparkSession, path: str) -> DataFrame:
    return RD.load_source(spark, "ParaMAWPS", path)


def load_svamp_data(spark: SparkSession, path: str) -> DataFrame:
    return RD.load_source(spark, "SVAMP", path)


def load_dmath_data(spark: SparkSession, path: str) -> DataFrame:
    return RD.load_source(spark, "DMath", path)


def load_aqua_data(spark: SparkSession, path: str) -> DataFrame:
    return RD.load_source(spark, "AQuA", path)


def get_cl_learning_data(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """The five curriculum datasets, standardised to (dataset, stage, row_key,
    question, answer); failing rows dropped, missing sources empty."""
    kept, _ = C.drop_unparseable(CU.standardised(RD.load_curriculum(spark, sources)), "question")
    return kept


def load_and_prepare_openwebmath(df: DataFrame, fraction: float = 0.001, seed: int = 42,
                                 key: str = "url") -> DataFrame:
    """Exactly ``int(size * fraction)`` seeded rows of a corpus."""
    return S.sample_fraction(df, fraction, seed, key)


# ----------------------------------------------------------------- shape ---


def prepare_datasets_qa(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt", B.sft_prompt("question", "answer"))


def prepare_instruction_data(df: DataFrame) -> DataFrame:
    return df.select(B.instruction_prompt("instruction", "output").alias("formatted_text"))


def exclude_sources_by_prefix(df: DataFrame, prefixes: Sequence[str], source: str = "source") -> DataFrame:
    return C.exclude_sources(df, prefixes, source)


def create_cot_prompt(train: DataFrame, n_shot: int = 8, seed: int = 42,
                      key: Sequence[str] = CONTENT) -> DataFrame:
    """One row: ``n_shot`` seeded examples as a chain-of-thought block."""
    key = [key] if isinstance(key, str) else list(key)
    shots = S.sample_n(train, n_shot, seed, key, order_col="__draw")
    return B.few_shot_block(shots, ["__draw", *key])


def create_five_shot_prompt(train: DataFrame, test: DataFrame, seed: int = 42,
                            key: Sequence[str] = CONTENT) -> DataFrame:
    """Every test question with the same five seeded shots before it."""
    return B.attach_shots(test, create_cot_prompt(train, 5, seed, key))


def tokenize_function(df: DataFrame, vocab: DataFrame, text: str = "text", max_length: int = 512,
                      pad: bool = True) -> DataFrame:
    return T.encode(df, vocab, text, max_length, pad)


# ---------------------------------------------------------------- answers --

extract_answer = A.extract_answer
extract_answer_gsm8k = A.extract_answer_plain
extract_predicted_answer = A.extract_predicted_answer
extract_ground_truth = A.extract_ground_truth
clean_text_for_number_extraction = A.clean_number_text
convert_to_number = A.to_number
is_correct_check = A.is_correct
post_process_response = A.post_process_response


def evaluate_model(responses: DataFrame, gold: DataFrame, majority_method: str = "none",
                   n_votes: int = 8, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Per-question results and accuracy over all gold questions (methods
    'none', 'maj@8', 'maj@k')."""
    results = EV.evaluate(responses, gold, method=majority_method, n_votes=n_votes, **kwargs)
    run = kwargs.get("run", "run")
    return results, EV.accuracy_by_run(results, run, gold=gold)


# ------------------------------------------------------------ files, logs ---


def save_dataset_to_disk(df: DataFrame, output_dir: str, format: str = "parquet") -> None:
    W.save_splits(df, output_dir, format)


def count_samples(spark: SparkSession, path: str) -> DataFrame:
    return P.parquet_stats(spark, path)


def training_speed(log: DataFrame, **kwargs) -> DataFrame:
    return R.training_speed(log, **kwargs)


def run_summary(log: DataFrame, **kwargs) -> DataFrame:
    return R.run_summary(log, **kwargs)
