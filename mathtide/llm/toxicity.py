"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Sentence s has p(s) = sigmoid(b + sum of the
weights of its distinct features: its words and the words' beginnings of 3 to 7
characters, since insults are inflected) and the bag 1 - prod(1 - p(s))
(noisy-or).  Only
document labels exist; the noisy-or's gradient gives the blame to the sentences
that explain the label.  The sentences with p(s) >= 0.5 are then the located
ones.

Fitting uses at most ``SAMPLE`` labelled rows (least xxhash64 of doc_id and label).  The
vocabulary is counted by Spark over them: features in at least ``LEAST_DOCS``
documents, the ``VOCABULARY`` ones most associated with either class.  A bag
then is small integers; proximal gradient steps with an L1 penalty leave
weights on few features.  Scoring passes every whole text through the weights.

Nulls: a null text is the empty text, a bag without sentences with score 0;
rows with a null label or doc_id are never learnt from.  Without both classes
in the sample every score is 0.  Repeated rows each get a row; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import fold, keep, labelled_texts
from mathtide.llm.quality_classifier import sample_labels

SAMPLE = 8_000
VOCABULARY = 3_000
LEAST_DOCS = 5
SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")
PREFIXES = range(3, 8)
CACHED_WORDS = 500_000
LASSO = 1e-4
STEPS = 400


def features(word: str) -> list[str]:
    """The word and its beginnings, marked with ^."""
    return [word] + ["^" + word[:k] for k in PREFIXES if len(word) > k]


def _bags(text: str | None, index: dict[str, int]) -> tuple[int, list[list[int]]]:
    """Number of sentences with a word, and the vocabulary ids of those with any."""
    n, hits = 0, []
    for s in SENTENCE.findall((text or "").lower()):
        found = TOKEN.findall(s)
        if found:
            n += 1
            ids = sorted({index[f] for w in set(found) for f in features(w) if f in index})
            if ids:
                hits.append(ids)
    return n, hits


def train(y: np.ndarray, sentences: np.ndarray, bags: list[list[list[int]]], size: int,
          penalty: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, bias) by accelerated proximal gradient (Adam scaling)."""
    doc = np.array([d for d, b in enumerate(bags) for _ in b], dtype=np.int64)
    flat = [s for b in bags for s in b]
    sent = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    word = np.array([w for s in flat for w in s], dtype=np.int64)
    plain = sentences - np.bincount(doc, minlength=len(bags))      # sentences without a vocabulary word
    w, b = np.zeros(size), -5.0
    mw, vw, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    n = len(y)
    for k in range(1, steps + 1):
        z = b + np.bincount(sent, weights=w[word], minlength=len(flat))
        soft = np.logaddexp(0, z)
        total = np.bincount(doc, weights=soft, minlength=n) + plain * np.logaddexp(0, b)
        p = -np.expm1(-total)
        share = np.where(y == 1, -(1 - p) / np.maximum(p, 1e-9), 1.0)       # d loss / d total
        gz = share[doc] / (1 + np.exp(-z)) / n
        gw = np.bincount(word, weights=gz[sent], minlength=size)
        gb = gz.sum() + (share * plain).sum() / (1 + np.exp(-b)) / n
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw ** 2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb ** 2
        rate = 0.1 / (1 + k / 200)
        scale = np.sqrt(vw / (1 - 0.99 ** k)) + 1e-5
        w = w - rate * mw / (1 - 0.9 ** k) / scale
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty / scale, 0)
        b -= rate * mb / (1 - 0.9 ** k) / (np.sqrt(vb / (1 - 0.99 ** k)) + 1e-5)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0,
        sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """({word: weight}, bias) learnt from labelled rows outside the fold."""
    chosen = sample_labels(labels, "toxic", modulus, held, sample)
    rows = keep(labelled_texts(docs, chosen), "toxic")

    def vocabulary(batches):
        for batch in batches:
            df, hit = Counter(), Counter()
            for t, y in zip(batch.column("text"), batch.column("y")):
                found = {f for w in set(TOKEN.findall((t.as_py() or "").lower())) for f in features(w)}
                df.update(found)
                if y.as_py():
                    hit.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()),
                 pa.array([hit[f] for f in df], pa.int64())], ["word", "df", "hit"])

    sizes = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, pos = sizes[0], sizes[1] or 0
    if not 0 < pos < n:
        return {}, -50.0
    # association: the z-score of the class shares with and without the word
    share = pos / n
    df, hit = F.col("df"), F.col("hit")
    z = F.abs(hit - df * share) / F.sqrt(df * F.lit(share * (1 - share)))
    counted = rows.select("text", "y").mapInArrow(vocabulary, "word string, df long, hit long").groupBy("word").agg(
        F.sum("df").alias("df"), F.sum("hit").alias("hit")).where(df >= LEAST_DOCS)
    names = [r[0] for r in counted.orderBy(z.desc(), "word").select("word").limit(VOCABULARY).collect()]
    index = {w: i for i, w in enumerate(names)}

    def bagged(batches):
        for batch in batches:
            found = [_bags(t.as_py(), index) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), batch.column("y").cast(pa.int32()), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.list_(pa.list_(pa.int32())))], ["at", "y", "n", "bags"])

    # at most ``sample`` rows, whatever the ids' type and however often one repeats
    data = rows.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("at"), "text", "y").mapInArrow(
        bagged, "at long, y int, n long, bags array<array<int>>").toPandas().sort_values(["at", "n"], kind="stable")
    w, b = train(data["y"].to_numpy(), data["n"].to_numpy(), [[list(s) for s in x] for x in data["bags"]], len(names))
    return {x: float(v) for x, v in zip(names, w) if abs(v) > 1e-6}, b


def score_text(text: str | None, weights: dict[str, float], bias: float,
               cache: dict[str, tuple] | None = None) -> tuple[float, list[tuple[int, int]]]:
    """(score, spans of the sentences with p >= 0.5), in code points.
    ``cache`` keeps the weighted features of words between calls."""
    cache = {} if cache is None else cache
    if len(cache) > CACHED_WORDS:
        cache.clear()
    text = text or ""
    total, spans = 0.0, []
    base = float(np.logaddexp(0, bias))
    telling = False
    for w in set(TOKEN.findall(text.lower())):
        found = cache.get(w)
        if found is None:
            found = cache[w] = tuple(f for f in features(w) if f in weights)
        telling = telling or bool(found)
    for m in SENTENCE.finditer(text):
        if not telling:
            total += base * bool(TOKEN.search(m[0]))
            continue
        found = TOKEN.findall(m[0].lower())
        if not found:
            continue
        z = bias + sum(weights[f] for f in {f for w in set(found) for f in cache.get(w, ())})
        total += float(np.logaddexp(0, z))
        if z >= 0:
            spans.append((m.start(), m.end()))
    return float(-np.expm1(-total)), spans


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start:end of the located
    sentences, comma-joined) of every document."""
    weights, bias = fit(docs, labels, modulus, held)
    rows = docs.select("doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "text")
    schema = rows.drop("text").withColumns({"score": F.lit(0.0), "spans": F.lit("")}).schema

    def run(batches):
        cache: dict[str, tuple] = {}
        for b in batches:
            found = [score_text(t.as_py(), weights, bias, cache) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([",".join(f"{s}:{e}" for s, e in f[1]) for f in found], pa.string())],
                ["doc_id", "held_out", "score", "spans"])

    return rows.mapInArrow(run, schema).select("doc_id", "held_out", "score",
                                               (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
