"""Secret scan: base patterns plus a character convolutional network.

Base findings come from three patterns over every whole text.  Candidates are
all runs of 12 or more token characters.  Each candidate is seen with its
surroundings as one window of ``WINDOW`` characters: the text before it, its
first and last characters, and the text behind it.  A run longer than the window
shows is seen as overlapping pieces, each with what surrounds it; its highest
score counts.  The network
(embedding, one convolution with ReLU, a maximum over the context and one over
the candidate, a logistic output) is trained on labelled findings:
pieces that overlap a base finding are positive, runs without one negative; every
positive also counts with its value in other surroundings, and so do values drawn anew
(``variants``), so that forms which no base pattern matches are found, too.  Its
outputs are calibrated on a held-out third by Platt scaling.  The threshold must
keep RECALL of the held-out positives; down from the largest that does, precision
stays the same until the next negative's score, and the middle of that gap is
taken.  Two networks are trained, each on one half of the windows (by candidate), and a
candidate is scored by the one that has not seen it: a key that no base pattern
matches is among the negatives, and a network would know it by heart.
Candidates above it that overlap no base finding are added as kind ``net``;
base findings always stay.

The texts are read once: findings and windows are written to the shared folder,
and scoring passes over every stored candidate.  All distinct windows are learnt
from.  By hash a third is held out and the rest dealt into slices, so many that
``ROUNDS`` rounds of ``STEPS`` steps of ``BATCH`` rows see every row of a slice
``PASSES`` times or more.  In a round every slice descends from the same parameters
in a task, with values drawn anew, and their mean is where the next round starts.
Negatives without a digit are far more than others, so every step takes a share of
each class (``shares``).
Platt scaling, the recall's order statistic and the negative below it are taken
over all held-out windows by Spark.

Nulls: a null text is empty and has no finding; null doc_ids are carried.
Repeated rows each get a row.  Without both labels nothing is added.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import keep

# fixed patterns; letters of the names in either case
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")        # 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "net")
LEAST_VALUE = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

BEFORE, FIRST, LAST, BEHIND = 32, 32, 16, 16
WINDOW = BEFORE + FIRST + LAST + BEHIND
PIECE, STRIDE = FIRST + LAST, (FIRST + LAST) // 2
EMBED, WIDTH, FILTERS, EPOCHS = 8, 5, 24, 12
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# alphabets that keys are drawn from
DRAWN = (LETTERS + LETTERS.lower() + "0123456789", LETTERS + LETTERS.lower() + "0123456789+/", "0123456789ABCDEF",
         LETTERS + LETTERS.lower() + "0123456789_-", LETTERS + "234567", LETTERS.lower() + "0123456789")
LEAST_DRAWN = 16
VARIANTS = 1_000         # drawn values at least, in the training and in the held-out part of a half
RECALL = 0.98
ROUNDS, STEPS, PASSES = 8, 80, 2
BATCH, LEAST = 128, (32, 1, 64)     # rows of a step; of negatives without and with a digit and of positives at least
HELD = 3                            # one window in so many is held out


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), kinds by place in KINDS, sorted."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _codes() -> np.ndarray:
    """Code of every byte: letters of either case, digits, each sign, blanks,
    and one for everything else; 0 pads."""
    table = np.full(256, 1, dtype=np.uint8)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        table[ord(c)] = 2 + i
    for i, c in enumerate("""+/_.=-:"'@,;()[]{}<>#&%$*! """):
        table[ord(c)] = 64 + i
    table[[9, 10, 11, 12, 13]] = 64 + 26
    table[0] = 0
    return table


CODES = _codes()
DIGITS = CODES[np.frombuffer(b"0123456789", dtype=np.uint8)].tobytes()
ALPHABET = 64 + 28


def window(text: str, start: int, end: int) -> bytes:
    """The candidate and its surroundings as WINDOW codes."""
    head = text[start:min(end, start + FIRST)]
    tail = text[max(start + FIRST, end - LAST):end]
    parts = (text[max(0, start - BEFORE):start].rjust(BEFORE, "\0"), head.ljust(FIRST, "\0"), tail.ljust(LAST, "\0"),
             text[end:end + BEHIND].ljust(BEHIND, "\0"))
    raw = np.frombuffer("".join(parts).encode("latin-1", "replace"), dtype=np.uint8)
    return CODES[raw].tobytes()


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping pieces of a run that a window shows whole."""
    starts = [*range(start, max(end - PIECE, start), STRIDE), max(end - PIECE, start)]
    return [(s, min(s + PIECE, end)) for s in starts]


OVERLAPS, BESIDE = 1, 2      # labels; 0: the run overlaps no base finding


def scan(text: str | None):
    """(base findings, [(start, end, label, window)]) with a row for every piece
    of a run.  OVERLAPS: the piece overlaps a base finding; BESIDE: another piece
    of its run does."""
    text = text or ""
    base = base_findings(text)
    candidates = []
    spans = sorted((s, e) for s, _, e in base)
    reach, starts, ends = 0, [s for s, _ in spans], []
    for s, e in spans:
        reach = max(reach, e)
        ends.append(reach)

    def overlaps(start, end):
        k = bisect_left(starts, end)
        return k > 0 and ends[k - 1] > start

    for m in CANDIDATE.finditer(text):
        other = BESIDE if overlaps(m.start(), m.end()) else 0
        for start, end in pieces(m.start(), m.end()):
            label = OVERLAPS if other and overlaps(start, end) else other
            candidates.append((m.start(), m.end(), label, window(text, start, end)))
    return base, candidates


def has_digit(w: bytes) -> bool:
    """Whether the candidate's part of a window holds a digit."""
    return len(w[BEFORE:BEFORE + PIECE].translate(None, DIGITS)) < PIECE


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


# -- the network ----------------------------------------------------------------------------------------------------------

def _forward(p: dict, x: np.ndarray):
    """Score before the sigmoid, and what the backward pass needs."""
    emb = p["e"][x]
    cols = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1).transpose(0, 1, 3, 2)
    act = np.maximum(cols.reshape(len(x), -1, WIDTH * EMBED) @ p["w"] + p["c"], 0)
    cut = BEFORE - WIDTH + 1
    at = np.concatenate((act[:, :cut].argmax(1), cut + act[:, cut:].argmax(1)), axis=1)
    pooled = np.take_along_axis(act, at.reshape(len(x), 2, FILTERS), axis=1).reshape(len(x), -1)
    return pooled @ p["u"] + p["d"], pooled, at


def variants(x: np.ndarray, y: np.ndarray, least: int = VARIANTS, seed=7) -> tuple[np.ndarray, np.ndarray]:
    """More positive windows, so that the network does not learn the base patterns
    alone: every positive's value, and as many (``least`` at least) drawn anew from
    DRAWN, each in the surroundings of a negative window.  A drawn value has digits."""
    rng = np.random.default_rng(seed)
    pos, neg = x[y == 1], x[y == 0]
    if not len(neg):
        return x, y
    made = np.concatenate([pos, np.zeros((max(len(pos), least), WINDOW), dtype=x.dtype)])
    around = neg[rng.integers(len(neg), size=len(made))]
    made[:, :BEFORE], made[:, BEFORE + PIECE:] = around[:, :BEFORE], around[:, BEFORE + PIECE:]
    for row in made[len(pos):]:
        alphabet = CODES[np.frombuffer(DRAWN[rng.integers(len(DRAWN))].encode(), dtype=np.uint8)]
        size = int(rng.integers(LEAST_DRAWN, PIECE + 1))
        value = rng.choice(alphabet, size)
        digits = rng.choice(size, max(2, size // 10), replace=False)
        value[digits] = np.frombuffer(DIGITS, dtype=np.uint8)[rng.integers(10, size=len(digits))]
        row[BEFORE:BEFORE + size] = value           # as ``window`` lays a short run out
    return np.concatenate([x, made]), np.concatenate([y, np.ones(len(made), dtype=y.dtype)])


def predict(p: dict, x: np.ndarray, rows: int = 512) -> np.ndarray:
    out = [_forward(p, x[i:i + rows])[0] for i in range(0, len(x), rows)]
    return np.concatenate(out) if out else np.zeros(0)


def network() -> dict:
    """The parameters that every training starts from."""
    rng = np.random.default_rng(3)
    p = {"e": rng.normal(0, 0.3, (ALPHABET, EMBED)), "w": rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)),
         "c": np.zeros(FILTERS), "u": rng.normal(0, 0.15, 2 * FILTERS), "d": np.zeros(())}
    return {k: v.astype(np.float32) for k, v in p.items()}


def descend(p: dict, batches: Iterable[tuple[np.ndarray, np.ndarray]], rate: float) -> dict:
    """The parameters after a step of Adam for every batch (windows, labels)."""
    p = dict(p)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    filters = np.tile(np.arange(FILTERS), 2)
    for xb, yb in batches:
        z, pooled, at = _forward(p, xb)
        gz = (1 / (1 + np.exp(-z)) - yb) / len(xb)
        ga = gz[:, None] * p["u"] * (pooled > 0)                       # at the pooled places only
        ids = xb[np.arange(len(xb))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        seen = p["e"][ids].reshape(len(xb), 2 * FILTERS, WIDTH * EMBED)
        per = np.einsum("nf,nfk->kf", ga, seen)
        gw = per[:, :FILTERS] + per[:, FILTERS:]
        back = (ga[:, :, None] * p["w"].T[filters]).reshape(-1, EMBED)
        ge = np.stack([np.bincount(ids.ravel(), weights=back[:, d], minlength=ALPHABET) for d in range(EMBED)], 1)
        gc = ga.sum(0)
        g = {"e": ge, "w": gw, "c": gc[:FILTERS] + gc[FILTERS:], "u": pooled.T @ gz, "d": gz.sum()}
        step += 1
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-7)
                    ).astype(np.float32)
    return p


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> dict:
    rng = np.random.default_rng(3)
    orders = (rng.permutation(len(x)) for _ in range(epochs))
    return descend(network(), ((x[o[i:i + 64]], y[o[i:i + 64]]) for o in orders for i in range(0, len(x), 64)), rate)


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 500) -> tuple[float, float]:
    """Platt scaling (a, b): p = sigmoid(a z + b), with smoothed targets."""
    pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - t
        a -= 0.05 * float((g * z).mean()) / max(float((z * z).mean()), 1e-6) * 4
        b -= 0.2 * float(g.mean())
    return a, b


def fit(x: np.ndarray, y: np.ndarray, recall: float = RECALL):
    """(parameters, a, b, threshold) of windows at hand, in one process, or None
    without both labels; ``fit_windows`` is for a table of them."""
    if len(y) < 12 or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 3 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        return None
    p = train(x[~held], y[~held])
    z = predict(p, x[held])
    a, b = calibrate(z, y[held])
    scores = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    pos, neg = np.sort(scores[y[held] == 1]), scores[y[held] == 0]
    most = float(pos[int(np.floor((1 - recall) * len(pos)))])
    below = neg[neg < most]
    return p, a, b, (most + float(below.max(initial=0.0))) / 2


def half(w: bytes) -> int:
    """The half of a window, by its candidate: a key is in one half wherever it stands."""
    return zlib.crc32(w[BEFORE:BEFORE + PIECE]) & 1


# -- the fit over all windows ---------------------------------------------------------------------------------------------

def shares(counts: Sequence[int]) -> list[int]:
    """Rows of a step from each class (negatives without and with a digit, positives):
    LEAST, and the rest of BATCH in proportion; none of an empty class."""
    least = [m if n else 0 for n, m in zip(counts, LEAST)]
    return [m + round((BATCH - sum(LEAST)) * n / sum(counts)) for n, m in zip(counts, least)]


def slice_count(counts: Sequence[int]) -> int:
    """Slices that let ROUNDS * STEPS steps see every row PASSES times."""
    return max(-(-PASSES * n // (ROUNDS * STEPS * take)) for n, take in zip(counts, shares(counts)) if n)


def step_count(counts: Sequence[int]) -> int:
    """Steps of a round: STEPS, fewer where a table is so small that they would see it more than EPOCHS times."""
    return min(STEPS, -(-EPOCHS * sum(counts) // (slice_count(counts) * ROUNDS * BATCH)))


def batches_of(x: np.ndarray, y: np.ndarray, take: Sequence[int], steps: int, turn: int, seed: int):
    """The batches of a slice in round ``turn``: each class is gone through in an
    order of its own, from where the round before stopped, again and again."""
    rng = np.random.default_rng(seed)
    digit = np.isin(x[:, BEFORE:BEFORE + PIECE], np.frombuffer(DIGITS, dtype=np.uint8)).any(1)
    parts = []
    for rows, n in zip(((y == 0) & ~digit, (y == 0) & digit, y == 1), take):
        order = rng.permutation(np.flatnonzero(rows))
        if len(order) and n:
            parts.append(order[np.arange(turn * steps * n, (turn + 1) * steps * n) % len(order)].reshape(steps, n))
    for rows in np.concatenate(parts, axis=1) if parts else ():
        yield x[rows].astype(np.int64), y[rows].astype(np.float32)


def arranged(windows: DataFrame, counts: dict[int, list[int]]) -> DataFrame:
    """One row per slice (slice, half, windows, labels, least number of drawn values);
    ``counts`` are the halves' class sizes."""
    n = {h: slice_count(c) for h, c in counts.items()}
    first = dict(zip(n, np.cumsum([0, *n.values()]).tolist()))
    slot = F.coalesce(*[F.when(F.col("half") == h, first[h] + F.pmod(F.xxhash64("w", F.lit(1)), F.lit(n[h]))) for h in n])
    least = {h: -(-VARIANTS // n[h]) for h in n}

    def run(batches):
        parts: dict[tuple, list] = {}
        for b in batches:
            slots = b.column("slice").to_numpy(zero_copy_only=False)
            for s in np.unique(slots).tolist():
                rows = b.filter(pa.array(slots == s))
                x = np.frombuffer(b"".join(rows.column("w").to_pylist()), dtype=np.uint8).reshape(-1, WINDOW)
                parts.setdefault((s, rows.column("half")[0].as_py()), []).append((x, rows.column("y").to_numpy() == OVERLAPS))
        for (s, h), got in parts.items():
            x, y = (np.concatenate(a) for a in zip(*got))
            order = np.argsort(np.ascontiguousarray(x).view(f"S{WINDOW}").ravel())      # the shuffle's order is left to chance
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([h], pa.int32()), pa.array([x[order].tobytes()], pa.binary()),
                 pa.array([y[order].astype(np.uint8).tobytes()], pa.binary()), pa.array([least[h]], pa.int32())],
                ["slice", "half", "x", "y", "least"])

    total = sum(n.values())
    return windows.where(F.col("half").isin(*n)).select("w", "y", "half", slot.cast("int").alias("slice")) \
        .repartitionById(total, "slice").mapInArrow(run, "slice int, half int, x binary, y binary, least int")


def slices_in(batches, turn: int):
    """(slice, half, windows, labels) of ``arranged`` rows with their variants, which
    are drawn anew for every ``turn``: those of one round would be learnt by heart."""
    for b in batches:
        for s, h, x, y, least in zip(*(b.column(c) for c in ("slice", "half", "x", "y", "least"))):
            s, x = s.as_py(), np.frombuffer(x.as_buffer(), dtype=np.uint8).reshape(-1, WINDOW)
            yield s, h.as_py(), *variants(x, np.frombuffer(y.as_buffer(), dtype=np.uint8), least.as_py(), seed=(s, turn))


GRAIN = 1 << 24      # parameters are summed in this fraction: exactly, whatever the tasks and their order


def one_round(slices: DataFrame, params: dict[int, dict], counts: dict[int, list[int]], turn: int) -> dict[int, dict]:
    """Every slice descends from its half's parameters; the mean of where they arrive."""
    rate = 0.01 * (1 - turn / ROUNDS)
    plan = {h: (shares(c), step_count(c)) for h, c in counts.items()}

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for s, h, x, y in slices_in(batches, turn):
            p = descend(params[h], batches_of(x, y, *plan[h], turn, s), rate)
            flat = np.concatenate([p[k].ravel() for k in sorted(p)] + [np.ones(1)]).astype(np.float64)
            sums[h] = sums.get(h, 0.0) + np.round(flat * GRAIN) / GRAIN
        for h, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), h, dtype=np.int32)), pa.array(np.arange(len(v), dtype=np.int32)),
                                              pa.array(v)], ["half", "at", "v"])

    out = {}
    rows = slices.mapInArrow(run, "half int, at int, v double").groupBy("half", "at").agg(F.sum("v").alias("v")).collect()
    for h, start in params.items():
        flat = np.array([v for _, v in sorted((r["at"], r["v"]) for r in rows if r["half"] == h)])
        mean, at, out[h] = flat[:-1] / flat[-1], 0, {}
        for k in sorted(start):
            out[h][k] = mean[at:at + start[k].size].reshape(start[k].shape).astype(np.float32)
            at += start[k].size
    return out


def order_key(z: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 to 2**32 - 1 in the order of the float32 ``z``."""
    bits = np.asarray(z, dtype=np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -1 - bits, bits + (1 << 31))


def from_key(key: int) -> float:
    bits = key - (1 << 31) if key >= 1 << 31 else -1 - key
    return float(np.array(bits, dtype=np.int32).view(np.float32))


def kth(keys: DataFrame, k: int) -> int:
    """The key with ``k`` rows before it, exactly: half of its 32 bits are counted at a time."""
    prefix = None
    for shift in (16, 0):
        rest = keys if prefix is None else keys.where(F.shiftright("key", 16) == prefix)
        for prefix, c in rest.groupBy(F.shiftright("key", shift).alias("p")).count().orderBy("p").collect():
            if k < c:
                break
            k -= c
    return prefix


def probability(z, a: float, b: float):
    return 1 / (1 + np.exp(-np.clip(a * np.asarray(z, dtype=np.float64) + b, -30, 30)))


def calibrated(held: DataFrame, recall: float = RECALL) -> tuple[float, float, float]:
    """(a, b, threshold) from the scores of all held-out windows (y, z, key) of a network."""
    n = {r["y"]: r["count"] for r in held.groupBy("y").count().collect()}
    # Platt's smoothed targets: every row counts for both labels
    up = F.when(F.col("y") == 1, (n[1] + 1) / (n[1] + 2)).otherwise(1 / (n[0] + 2))
    both = held.select(array_to_vector(F.array(F.col("z").cast("double"))).alias("features"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), up.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - up).alias("weight")))).alias("t"))
    model = LogisticRegression(weightCol="weight").fit(both.select("features", "t.*"))
    a, b = round(float(model.coefficients[0]), 6), round(float(model.intercept), 6)
    top = (1 << 32) - 1
    ranked = held.select("y", (F.col("key") if a >= 0 else F.lit(top) - F.col("key")).alias("key"))
    at = kth(ranked.where("y = 1"), int(np.floor((1 - recall) * n[1])))
    below = ranked.where((F.col("y") == 0) & (F.col("key") < at)).agg(F.max("key")).first()[0]
    most, least = (float(probability(from_key(k if a >= 0 else top - k), a, b)) if k is not None else 0.0 for k in (at, below))
    return a, b, (most + least) / 2


def fit_windows(windows: DataFrame) -> list:
    """(parameters, a, b, threshold) of the network for either half of the windows
    (w, y, d), learnt from the other half; None where that lacks a label."""
    rows = windows.select("w", F.when(F.col("y") == OVERLAPS, 1).otherwise(0).alias("y"), "d",
                          F.crc32(F.substring("w", BEFORE + 1, PIECE)).bitwiseAND(F.lit(1)).cast("int").alias("half"),
                          (F.pmod(F.xxhash64("w"), F.lit(HELD)) == 0).alias("held"))
    kinds = [(F.col("y") == 0) & ~F.col("d"), (F.col("y") == 0) & F.col("d"), F.col("y") == 1]
    found = {(r["half"], r["held"]): list(r[2:]) for r in rows.groupBy("half", "held").agg(
        *[F.count_if(k).alias(f"n{i}") for i, k in enumerate(kinds)]).collect()}
    halves = [h for h in (0, 1) if all(sum(found.get((h, held), [0])[:2]) for held in (False, True))
              and found[h, False][2] + found[h, True][2]]
    if not halves:
        return [None, None]
    # of a positive there are two windows and a drawn value
    counts = {held: {h: [plain, digit, 2 * pos + max(pos, VARIANTS)] for h in halves for plain, digit, pos in [found[h, held]]}
              for held in (False, True)}
    slices = keep(arranged(rows.where(~F.col("held")), counts[False]), "slices")
    params = {h: network() for h in halves}
    for turn in range(ROUNDS):
        params = one_round(slices, params, counts[False], turn)

    def score(batches):
        for _, h, x, y in slices_in(batches, ROUNDS):
            for at in range(0, len(y), 4096):
                z = predict(params[h], x[at:at + 4096].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(z), h, dtype=np.int32)), pa.array(y[at:at + 4096].astype(np.int32)),
                     pa.array(z.astype(np.float32)), pa.array(order_key(z))], ["half", "y", "z", "key"])

    held = keep(arranged(rows.where("held"), counts[True]).mapInArrow(score, "half int, y int, z float, key long"), "held")
    fitted = {h: (params[h], *calibrated(held.where(F.col("half") == h).drop("half"))) for h in halves}
    return [fitted.get(1 - k) for k in (0, 1)]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    rows = docs.select("doc_id", "text")
    found_type = "n_assign long, n_access long, n_hex long, base string, candidates array<struct<s:int,e:int,y:int,w:binary,d:boolean>>"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cells = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("y", pa.int32()), ("w", pa.binary()),
                               ("d", pa.bool_())]))

    def extract(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                piece = b.slice(at, 500)
                got = [scan(t.as_py()) for t in piece.column("text")]
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in got] for kind in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                     pa.array([joined(base) for base, _ in got], pa.string()),
                     pa.array([[dict(zip("seywd", (*c, has_digit(c[3])))) for c in cs] for _, cs in got], cells)],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base", "candidates"])

    parts = keep(rows.mapInArrow(extract, f"doc_id {id_type}, {found_type}"), "findings")
    windows = keep(parts.select(F.explode("candidates").alias("c")).where(F.col("c.y") != BESIDE).groupBy("c.w").agg(
        F.max("c.y").alias("y"), F.max("c.d").alias("d")), "windows")
    models = fit_windows(windows)

    def add(batches):
        for b in batches:
            spans, sums = [], []
            cands = b.column("candidates").to_pylist()
            new = [(i, c) for i, cs in enumerate(cands) for c in cs if not c["y"]]
            added: dict[int, set] = {}      # a run is added once, however many of its pieces score
            for k, model in enumerate(models):
                own = [(i, c) for i, c in new if model and half(c["w"]) == k]
                for at in range(0, len(own), 4096):
                    p, a, c0, threshold = model
                    part = own[at:at + 4096]
                    xs = np.array([np.frombuffer(c["w"], dtype=np.uint8) for _, c in part], dtype=np.int64)
                    for (i, c), s in zip(part, probability(predict(p, xs), a, c0)):
                        if s >= threshold:
                            added.setdefault(i, set()).add((c["s"], 3, c["e"]))
            for i, base in enumerate(b.column("base").to_pylist()):
                sums.append(hashlib.sha256(base.encode()).hexdigest())
                old = [x.split(":") for x in base.split(",")] if base else []
                spans.append(joined([(int(s), KINDS.index(k), int(e)) for k, s, e in old] + [*added.get(i, ())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")]
                + [pa.array(sums, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return parts.mapInArrow(add, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
