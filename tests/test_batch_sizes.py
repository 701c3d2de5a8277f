"""Pieces that Python works on at once: bounded texts, generator batches without a frame each."""

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from mathtide.operators import tokens as T
from mathtide.operators import udf as U


def test_tokenised_pieces_are_bounded(spark, monkeypatch):
    seen = []
    whole = T.arrow_token_lists
    monkeypatch.setattr(T, "arrow_token_lists", lambda t: (seen.append(pc.sum(pc.binary_length(t)).as_py() or 0), whole(t))[1])
    df = spark.createDataFrame([(0, "a b", [1])], "id long, text string, x array<int>")
    got = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: got.append(fn) or self)
    T.encode(df, spark.createDataFrame([("w", 3, 1)], "token string, id long, count long"), max_length=8)
    texts = ["w w " * 50_000, None, "w", *["w x " * 1000] * 3000, "", "w " * 3_000_000, "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()),
                                        pa.array([[1]] * len(texts), pa.list_(pa.int32()))], names=["id", "text", "x"])
    out = pa.Table.from_batches(list(got[0]([batch])))
    assert sorted(seen)[-2] <= T.SLICE_TEXT and sum(seen) == sum(len(t or "") for t in texts)
    assert out.column("id").to_pylist() == list(range(len(texts)))
    ids = out.column("input_ids").to_pylist()
    assert ids[1] == [0] * 8 and ids[2] == [3] + [0] * 7 and ids[3] == [3, 1] * 4 and ids[-1] == [1] + [0] * 7


def test_generator_batches_are_exact_and_frames_stay_large():
    frames = [pd.DataFrame({"id": range(k, k + n)}) for k, n in ((0, 100), (100, 1), (101, 27), (128, 3))]
    out = list(U._rebatch(iter(frames), 64, whole_batches=True))
    assert [len(f) for f in out] == [64, 64, 3]
    assert list(pd.concat(out)["id"]) == list(range(131))
    big = list(U._rebatch(iter([pd.DataFrame({"id": range(1000)})]), 64, whole_batches=True))
    assert [len(f) for f in big] == [960, 40]


def test_generated_responses_are_of_their_rows(spark):
    sizes = spark.sparkContext.accumulator(0)

    def generate(prompts, votes):
        assert len(prompts) <= 7
        sizes.add(1)
        return prompts + ":" + votes.astype(str)
    df = spark.range(0, 50, numPartitions=1).selectExpr("cast(id as string) as prompt")
    rows = U.batch_generate(df, generate, n_votes=3, batch_size=7).collect()
    assert len(rows) == 150 and all(r.response == f"{r.prompt}:{r.vote}" for r in rows)
    assert sizes.value == 22
