"""Streams that carry state from one micro-batch to the next: totals, buffer, restarts."""
import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mathtide.operators import runlog, voting
from mathtide.session import scratch_path
from mathtide.streaming import carried
from mathtide.streaming import jobs as J

BASE = 1_700_000_000


@pytest.fixture()
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def write_parts(parts, folder):
    """One file per frame, modified in this order."""
    for k, df in enumerate(parts):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        df.coalesce(1).write.mode("append").parquet(folder)
        for f in set(os.listdir(folder)) - before:
            os.utime(os.path.join(folder, f), (BASE + k, BASE + k))


def examples(spark, part):
    run = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 2 == 0, "a").otherwise("b")
    return spark.range(part * 100, part * 100 + 100).select(run.alias("run"), F.col("id").alias("k"),
                                                            F.when(F.col("id") % 7 > 0, F.col("id") % 3 == 0).alias("correct"))


def accuracy_rows(df):
    return sorted(map(tuple, df.select("run", "k", "example_idx", "running_correct").collect()), key=repr)


def test_running_accuracy_across_batches(spark, tmp_dir, few_partitions, monkeypatch):
    folder = os.path.join(tmp_dir, "examples")
    write_parts([examples(spark, k) for k in range(3)], folder)
    want = accuracy_rows(voting.running_accuracy(spark.read.parquet(folder), "correct", ["k"], "run"))
    # one file a batch, slices of 16 rows; then all in one batch
    for slice_rows, files in ((16, 1), (1 << 16, 3)):
        monkeypatch.setattr(carried, "SLICE_ROWS", slice_rows)
        stream = carried.placed(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=files))
        assert accuracy_rows(J.stream_running_accuracy(stream)) == want


def test_running_accuracy_goes_on_after_a_kill(spark, tmp_dir, few_partitions, monkeypatch):
    """Killed in the second batch, after its stateful part ran and before its
    output was written; started again on the same checkpoint; then more files."""
    folder, out, ckpt = (os.path.join(tmp_dir, x) for x in ("ex", "out", "ckpt"))
    write_parts([examples(spark, k) for k in range(3)], folder)

    def run():
        stream = carried.placed(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=1))
        return accuracy_rows(J.stream_running_accuracy(stream, out=out, checkpoint=ckpt))

    def lost(*args):
        if os.path.isdir(f"{out}/_batch=0"):
            raise RuntimeError("executor lost")
        return whole(*args)
    whole = carried.running
    monkeypatch.setattr(carried, "running", lost)
    with pytest.raises(StreamingQueryException, match="executor lost"):
        run()
    first = accuracy_rows(spark.read.parquet(f"{out}/_batch=0"))
    assert len(first) == 100 and not os.path.isdir(f"{out}/_batch=1")
    monkeypatch.undo()
    got = run()
    assert got == accuracy_rows(voting.running_accuracy(spark.read.parquet(folder), "correct", ["k"], "run"))
    assert set(first) < set(got)
    # a later file is one more batch of the same totals
    examples(spark, 3).coalesce(1).write.mode("append").parquet(folder)
    assert run() == accuracy_rows(voting.running_accuracy(spark.read.parquet(folder), "correct", ["k"], "run"))


def test_speed_steps_across_batches(spark, tmp_dir, few_partitions):
    folder = os.path.join(tmp_dir, "steps")
    t0 = dt.datetime(2024, 1, 1)
    write_parts([spark.createDataFrame(
        [("r" if i % 3 else "s", i, t0 + dt.timedelta(milliseconds=1 + 3 * i), 4, 2) for i in range(part * 40, part * 40 + 40)],
        "run string, event_id long, ts timestamp_ntz, batch int, accumulation int") for part in range(3)], folder)
    stream = carried.placed(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=1))
    got, want = J.stream_speed_steps(stream), runlog.training_speed(spark.read.parquet(folder))
    cols = ["run", "step", "total_samples", "elapsed_s"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert got.count() == want.count() > 0


def replay(records, size, seed):
    """The buffer, record by record, with the draws of ``slot_of``."""
    import hashlib
    buffer, out = {}, []
    for at, record in enumerate(records):
        slot = at if at < size else int(hashlib.md5(f"{seed}:{at}".encode()).hexdigest()[:8], 16) % size
        if slot in buffer:
            out.append(buffer[slot])
        buffer[slot] = record
    return out + [buffer[s] for s in sorted(buffer, key=lambda s: hashlib.md5(f"{seed}:end:{s}".encode()).hexdigest())]


def test_buffer_shuffle(spark, tmp_dir, few_partitions):
    df = spark.range(300).select(F.col("id").alias("at"), F.concat(F.lit("t\n\""), "id").alias("text"),
                                 F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"),
                                 (F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(0,0,0,id/3)")).alias("ts"))
    folder = os.path.join(tmp_dir, "records")
    files = J.stage_in_order(df, ["at"], folder, least_files=4)
    assert files == 4
    order = {}
    for size, per in ((16, 1), (16, 4), (500, 2)):
        out = carried.buffer_shuffle(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=per), "at", size, 7)
        rows = out.orderBy("shuffle_pos").collect()
        assert [r["shuffle_pos"] for r in rows] == list(range(300))
        assert [r["at"] for r in rows] == replay(range(300), size, 7)
        assert sorted(map(tuple, out.drop("shuffle_pos").collect())) == sorted(map(tuple, df.collect()))
        order[size, per] = [r["at"] for r in rows]
    moved = [k - at for k, at in enumerate(order[16, 1])]
    assert max(moved) > 16 and min(moved) > -16          # beyond its buffer
    assert order[16, 1] == order[16, 4]


def test_buffer_outlives_the_query(spark, tmp_dir, few_partitions):
    folder, out, ckpt = (os.path.join(tmp_dir, x) for x in ("recs", "out", "ckpt"))
    numbers = [spark.range(k * 50, k * 50 + 50).toDF("at") for k in range(3)]
    write_parts(numbers[:2], folder)

    def run():
        return carried.buffer_shuffle(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=1), "at", 16, 7,
                                      out=out, checkpoint=ckpt)
    assert run().count() == 100
    numbers[2].coalesce(1).write.mode("append").parquet(folder)
    assert [r["at"] for r in run().orderBy("shuffle_pos").collect()] == replay(range(150), 16, 7)


def test_staged_positions(spark, tmp_dir):
    df = spark.createDataFrame([(k % 7, k) for k in range(100)] + [(None, 500)], "a long, b long")
    folder = os.path.join(tmp_dir, "staged")
    files = J.stage_in_order(df, ["a", "b"], folder, position="p", least_files=5)
    assert files == 5
    rows = spark.read.parquet(folder).select("*", "_metadata.file_modification_time", "_metadata.row_index").collect()
    by_place = sorted(rows, key=lambda r: (r["file_modification_time"], r["row_index"]))
    assert [r["p"] for r in by_place] == list(range(101))
    assert [(r["a"], r["b"]) for r in by_place] == sorted([tuple(r) for r in df.collect()], key=lambda t: (t[0] is not None, t))


def test_a_stream_from_a_stated_position(spark, tmp_dir):
    """Without a checkpoint: behind any row, in the middle of a file or at its end."""
    folder = os.path.join(tmp_dir, "at")
    write_parts([spark.range(k * 10, k * 10 + 10) for k in range(3)], folder)
    whole = J.run_to_table(carried.placed(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=1)), "t")
    rows = {r["id"]: r for r in whole.collect()}
    for last in (0, 9, 14, 29):
        stream = carried.placed(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=2))
        rest = J.run_to_table(carried.after(stream, *(rows[last][c] for c in carried.PLACE)), "t")
        assert sorted(r["id"] for r in rest.collect()) == list(range(last + 1, 30))


def test_head_ends_the_source(spark, tmp_dir):
    folder, out, ckpt = (os.path.join(tmp_dir, x) for x in ("head", "out", "ckpt"))
    write_parts([spark.range(k * 10, k * 10 + 10) for k in range(5)], folder)

    def run(n):
        stream = J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=1)
        return sorted(r["id"] for r in J.run_head(stream, n, "t", ["id"], out=out, checkpoint=ckpt).collect())
    assert run(15) == list(range(15))
    assert sorted(os.listdir(out)) == ["_batch=0", "_batch=1"]
    assert run(15) == list(range(15))                       # a restart takes no more
    assert J.run_head(J.file_stream(spark, folder, "*.parquet"), 0, "none", ["id"]).count() == 0


def test_stream_resumes_at_its_checkpoint(spark, tmp_dir):
    folder, out, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "out", "ckpt"))
    write_parts([spark.range(k * 10, k * 10 + 10) for k in range(2)], folder)

    def run():
        return J.run_to_table(J.file_stream(spark, folder, "*.parquet", max_files_per_trigger=1), "t", out=out, checkpoint=ckpt)
    assert run().count() == 20
    write_parts([spark.range(20, 25)], folder)
    os.utime(os.path.join(folder, max(os.listdir(folder), key=lambda f: os.path.getmtime(os.path.join(folder, f)))))
    assert sorted(r["id"] for r in run().collect()) == list(range(25))
    assert sorted(os.listdir(out)) == ["_batch=0", "_batch=1", "_batch=2"]
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
