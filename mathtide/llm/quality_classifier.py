"""Quality classifier as a sparse rule ensemble.

Statistics of each whole text are built-in column expressions.  On a bounded
sample of labelled rows small regression trees are boosted on the logistic
residual; every tree path becomes a conjunctive rule (``shouts > 0.2 and
n_lines <= 3``); a lasso logistic regression over the rules keeps few of them;
and those compile to one Spark column, so scoring is a plain projection.

Fitting uses at most ``SAMPLE`` labelled rows, those with the least xxhash64 of
their doc_id and label; only their statistics reach the driver.

Nulls: a null text is the empty text, whose statistics are all 0, and gets a
score like any other; rows with a null label or doc_id are never learnt from.
Repeated rows each get a row.  Without labelled rows the score is 1 (nothing
can be held against a document); with one class it is the smoothed class share.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import BLANKS, fold, labelled_texts, least_hashed, text_or_empty, words

SAMPLE = 20_000
TREES, DEPTH, CUTS = 40, 3, 24
LASSO = 0.002
CUTOFF = 0.7

STATISTICS = ("n_words", "word_length", "symbols", "shouts", "pipes", "upper", "digits", "stops", "commas", "lines",
              "dup_lines", "distinct", "longest_run")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Add ``__q_<statistic>`` for each of STATISTICS."""
    text = F.col("__q_text")

    def count(chars):
        return F.col("__q_chars") - F.length(F.translate(text, chars, ""))

    df = docs.withColumn("__q_text", text_or_empty())
    df = df.withColumns({"__q_w": words(text), "__q_chars": F.length(text),
                         "__q_l": F.filter(F.split(text, "\n", -1),
                                           lambda x: F.length(F.translate(x, BLANKS, "")) > 0)})
    df = df.withColumns({"__q_n": F.size("__q_w").cast("double"), "__q_d": F.greatest(F.size("__q_w"), F.lit(1)).cast("double"),
                         "__q_c": F.greatest(F.col("__q_chars"), F.lit(1)).cast("double")})
    # words equal to the word before them
    w = F.col("__q_w")
    runs = F.size(F.filter(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b")),
                           lambda x: x["a"] == x["b"]))
    per_word, per_char = F.col("__q_d"), F.col("__q_c")
    made = {
        "n_words": F.log1p("__q_n"), "word_length": F.length(F.translate(text, BLANKS, "")) / per_word,
        "symbols": count("#*$%&<>") / per_word, "shouts": count("!") / per_word, "pipes": count("|") / per_word,
        "upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / per_char, "digits": count("0123456789") / per_char,
        "stops": count(".?") / per_word, "commas": count(",;:") / per_word, "lines": F.size("__q_l") / per_word,
        "dup_lines": (F.size("__q_l") - F.size(F.array_distinct("__q_l"))) / F.greatest(F.size("__q_l"), F.lit(1)),
        "distinct": F.size(F.array_distinct(w)) / per_word, "longest_run": runs / per_word,
    }
    df = df.withColumns({f"__q_{k}": made[k].cast("double") for k in STATISTICS})
    return df.drop("__q_text", "__q_w", "__q_chars", "__q_l", "__q_n", "__q_d", "__q_c")


def sample_labels(labels: DataFrame, target: str, modulus: int, held: int, size: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most ``size`` labelled rows outside the held-out fold."""
    usable = F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold("doc_id", modulus) != held)
    return least_hashed(labels.where(usable).select("doc_id", F.col(target).cast("int").alias("y")), ["doc_id", "y"], size)


# -- trees ---------------------------------------------------------------------------------------------------------

def _best_split(x: np.ndarray, r: np.ndarray, cuts: list[np.ndarray]):
    """(gain, feature, threshold) of the least-squares split of residuals r."""
    best = (1e-9, -1, 0.0)
    n, total = len(r), r.sum()
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        at = np.searchsorted(c, x[:, j], side="left")       # x <= c[k] for k >= at
        left_n = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
        left_s = np.cumsum(np.bincount(at, weights=r, minlength=len(c) + 1))[:-1]
        right_n = n - left_n
        ok = (left_n >= 5) & (right_n >= 5)
        gain = np.where(ok, left_s ** 2 / np.maximum(left_n, 1) + (total - left_s) ** 2 / np.maximum(right_n, 1)
                        - total ** 2 / n, -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(c[k]))
    return best


def _grow(x, r, cuts, rows, path, rules, update, depth):
    """Grow one tree on ``rows``; collect its paths and write leaf values."""
    if path:
        rules.add(tuple(path))
    gain, j, t = _best_split(x[rows], r[rows], cuts) if depth and len(rows) >= 10 else (0, -1, 0.0)
    if j < 0:
        update[rows] = r[rows].mean() if len(rows) else 0.0
        return
    left = x[rows, j] <= t
    _grow(x, r, cuts, rows[left], path + [(j, True, t)], rules, update, depth - 1)
    _grow(x, r, cuts, rows[~left], path + [(j, False, t)], rules, update, depth - 1)


def applies(rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for j, below, t in rule:
        hit &= (x[:, j] <= t) if below else (x[:, j] > t)
    return hit


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[tuple]:
    """Paths of boosted trees, each tree on a random half of the rows."""
    rng = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
    f = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: set[tuple] = set()
    for _ in range(trees):
        r = y - 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), size=max(len(y) // 2, min(len(y), 10)), replace=False))
        update, found = np.zeros(len(y)), set()
        _grow(x, r, cuts, rows, [], found, update, depth)
        rules |= found
        f += update
    return sorted(rules)


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 400):
    """(weights, intercept) of an L1-penalised logistic regression (FISTA)."""
    n, k = m.shape
    w, b, v, vb, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    # the largest eigenvalue by power iteration bounds the step
    u = np.ones(k)
    for _ in range(20):
        u = m.T @ (m @ u)
        u /= max(np.linalg.norm(u), 1e-12)
    rate = 1.0 / (0.25 * (float(np.linalg.norm(m @ u) ** 2) / n + 1.0) + 1e-9)
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(m @ v + vb))) - y
        new = v - rate * (m.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = vb - rate * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, target: str = "quality",
        sample: int = SAMPLE):
    """(rules, weights, intercept) learnt from labelled rows outside the fold."""
    chosen = sample_labels(labels, target, modulus, held, sample)
    rows = with_statistics(labelled_texts(docs, chosen)).select("doc_id", "y", *[f"__q_{k}" for k in STATISTICS])
    # at most ``sample`` rows; sorted here, as a sort in Spark would compute the statistics twice
    found = sorted((str(r[0]), *(float(v) for v in tuple(r)[1:])) for r in rows.collect())
    data = np.array([r[1:] for r in found], dtype=float).reshape(-1, len(STATISTICS) + 1)
    y, x = data[:, 0], data[:, 1:]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 1)
        return [], np.zeros(0), float(np.log(share / (1 - share))) if share < 1 else 50.0
    rules = extract_rules(x, y)
    m = np.stack([applies(r, x) for r in rules], axis=1).astype(float)
    w, b = lasso_logistic(m, y)
    used = np.abs(w) > 1e-6
    return [r for r, u in zip(rules, used) if u], w[used], float(b)


def compile_score(rules, weights, intercept) -> Column:
    """The ensemble as one column over the statistics of ``with_statistics``."""
    z = F.lit(float(intercept))
    for rule, weight in zip(rules, weights):
        hit = F.lit(True)
        for j, below, t in rule:
            c = F.col(f"__q_{STATISTICS[j]}")
            hit = hit & ((c <= t) if below else (c > t))
        z = z + F.when(hit, F.lit(float(weight))).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-z))


def classify(docs: DataFrame, model) -> DataFrame:
    """``docs`` with ``__score``, the probability of good quality."""
    return with_statistics(docs).withColumn("__score", compile_score(*model)).drop(*[f"__q_{k}" for k in STATISTICS])


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, modulus, held)
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", modulus) == held).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= CUTOFF).cast("int").alias("predicted"))
