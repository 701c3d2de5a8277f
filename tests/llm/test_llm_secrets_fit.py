"""The secret scan's networks, calibration and threshold come from all windows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from mathtide.llm import secrets


@pytest.fixture(scope="module")
def labelled(spark):
    """More distinct windows than a fit once sampled: 9,000 runs without a digit, 200 with one, 300 keys."""
    rng = np.random.default_rng(1)
    letters, hexed = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789abcdef")
    texts = [f"some {''.join(rng.choice(letters, 14))} things" for _ in range(9_000)]
    texts += [f"see docs/part-{rng.integers(10**6)}/{''.join(rng.choice(letters, 6))} there" for _ in range(200)]
    texts += [f"use token = \"{''.join(rng.choice(hexed, 32))}\" here" for _ in range(300)]
    want = {}
    for text in texts:
        for _, _, y, w in secrets.scan(text)[1]:
            if y != secrets.BESIDE:
                want[w] = max(want.get(w, 0), y)
    rows = [(bytearray(w), y, secrets.has_digit(w)) for w, y in want.items()]
    return want, spark.createDataFrame(rows, "w binary, y int, d boolean").repartition(8).cache()


def test_every_window_is_learnt_or_held_out(labelled, monkeypatch):
    want, windows = labelled
    monkeypatch.setattr(secrets, "ROUNDS", 2)
    monkeypatch.setattr(secrets, "STEPS", 20)
    frames, real = [], secrets.arranged
    monkeypatch.setattr(secrets, "arranged", lambda w, c: frames.append((real(w, c), c)) or frames[-1][0])
    assert all(secrets.fit_windows(windows))
    got = {}
    for k, (frame, counts) in enumerate(frames):
        rows = frame.collect()
        assert len({r["slice"] for r in rows}) == len(rows) > 2
        for r in rows:
            x = np.frombuffer(r["x"], dtype=np.uint8).reshape(-1, secrets.WINDOW)
            y = np.frombuffer(r["y"], dtype=np.uint8)
            for w, label in zip(x, y.tolist()):
                assert w.tobytes() not in got and secrets.half(w.tobytes()) == r["half"]
                got[w.tobytes()] = label
            if k == 0:      # the rounds go through every row of the slice
                c = counts[r["half"]]
                seen = {w.tobytes() for turn in range(2) for xb, _ in secrets.batches_of(
                    x, y, secrets.shares(c), secrets.step_count(c), turn, r["slice"]) for w in xb.astype(np.uint8)}
                assert seen == {w.tobytes() for w in x}
    assert got == {w: int(y == secrets.OVERLAPS) for w, y in want.items()}


def test_fit_does_not_depend_on_partitions(labelled, monkeypatch):
    _, windows = labelled
    monkeypatch.setattr(secrets, "ROUNDS", 2)
    monkeypatch.setattr(secrets, "STEPS", 20)
    one, two = (secrets.fit_windows(w) for w in (windows, windows.coalesce(1).orderBy(F.desc("w"))))
    for (p, *rest), (q, *other) in zip(one, two):
        assert rest == other and all(np.array_equal(p[k], q[k]) for k in p)


def test_threshold_from_all_held_out_scores(spark):
    """Calibration and threshold equal those of the scores at hand, also for a network that is worse than chance."""
    rng = np.random.default_rng(6)
    y = (rng.random(6_000) < 0.2).astype(int)
    for sign in (1, -1):
        z = (sign * (rng.normal(0, 1.5, 6_000) + 2 * y - 1)).astype(np.float32)
        rows = list(zip(y.tolist(), z.tolist(), secrets.order_key(z).tolist()))
        a, b, threshold = secrets.calibrated(spark.createDataFrame(rows, "y int, z float, key long"))
        p = secrets.probability(z, a, b)
        most = np.sort(p[y == 1])[int(np.floor((1 - secrets.RECALL) * y.sum()))]
        assert threshold == pytest.approx((most + p[(y == 0) & (p < most)].max()) / 2, rel=1e-12)
        wa, wb = secrets.calibrate(z.astype(float), y, steps=5_000)
        assert (a, b) == pytest.approx((wa, wb), rel=1e-2, abs=1e-2)


def test_order_keys_of_floats(spark):
    z = np.array([-np.inf, -3.5, -1e-30, -0.0, 0.0, 1e-30, 2.0, 2.0000002, np.inf], dtype=np.float32)
    keys = secrets.order_key(z)
    assert (np.diff(keys) > 0).all() and [secrets.from_key(int(k)) for k in keys] == z.tolist()
    df = spark.createDataFrame([(int(k),) for k in np.repeat(keys, 3)], "key long")
    assert [secrets.kth(df, k) for k in (0, 4, 13, 26)] == np.repeat(keys, 3)[[0, 4, 13, 26]].tolist()


def test_shares_and_slices():
    """A step takes all classes that have rows; slices hold what the steps can see."""
    for counts in ([26_000, 300, 1_300], [5, 0, 1_000], [1, 1, 1_000], [10**9, 10**7, 10**7], [100, 10**6, 10**6]):
        take, n = secrets.shares(counts), secrets.slice_count(counts)
        assert all((t > 0) == (c > 0) for t, c in zip(take, counts))
        assert all(secrets.ROUNDS * secrets.STEPS * t * n >= secrets.PASSES * c for t, c in zip(take, counts))
        assert 1 <= secrets.step_count(counts) <= secrets.STEPS
