"""Language-model scoring with a log-bilinear model.

Tokens are the words of the A-Z-lower-cased text and one end per document.
Counts of all training tokens (documents outside the held-out fold) are a
distributed aggregate; the vocabulary grows with the corpus and never reaches
one machine.

Model: two levels.  P(class | two classes before) is log-bilinear, score = (C1 r1 +
C2 r2) . q + b; the ``MODEL_WORDS`` most frequent tokens are classes of their own, and
every rarer word, seen or not, belongs to the class of its ending (its last two
characters; ``ENDINGS`` most frequent endings, one class for the rest).  A rarer word
then gets its smoothed share of its class, (c + 1) / (N' + V' + 1).  So all words
of the corpus are in the model, as contexts and as outcomes.  Noise-contrastive estimation in numpy: every training
partition runs stochastic gradient steps over all of its documents, starting
from the same parameters, and the parameters are averaged by their tokens
(bounded size: classes x DIMENSIONS).  Normalisation is exact: batched
matrix products give the log partition function of every pair of classes once, so
a token's normalised log-probability is a few table look-ups.

Base: sum over tokens of log10((c + 1) / (N + V + 1)).

Frequent tokens (at most ``HEAD``, a bound on the broadcast; tokens of equal count
are in or out together) are looked up where the text is; the others are joined
with the counts by token.

Nulls: a null text is empty and has one token, its end; a null doc_id is
carried, and counts as the empty text for the fold.  Repeated rows each get a
row.  Without training documents N = V = 0 and the model is uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mathtide.llm.common import fold, keep

MODEL_WORDS = 768        # most frequent tokens, classes of their own
ENDINGS = 255            # classes of rarer words
DIMENSIONS = 16
HEAD = 65_536            # most frequent tokens looked up without a join
BATCH, NOISE, RATE = 4096, 64, 0.05
END = "\n"               # the end token; no word contains a line break
SEED = 11


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, words per text)."""
    lowered = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lists = pc.ascii_split_whitespace(lowered)
    flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(lowered, "").to_numpy(zero_copy_only=False)     # splits into one empty string
    if empty.any():
        flat = flat.filter(pa.array(np.repeat(~empty, lengths)))
    return flat, np.where(empty, 0, lengths)


def token_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts in order, each text closed by END; tokens per text)."""
    flat, words = word_lists(texts)
    ends = np.cumsum(words + 1) - 1
    order = np.full(int((words + 1).sum()), -1, dtype=np.int64)
    inside = np.ones(len(order), dtype=bool)
    inside[ends] = False
    order[inside] = np.arange(len(flat))
    order[ends] = len(flat)
    return pa.concat_arrays([flat, pa.array([END], pa.string())]).take(pa.array(order)), words + 1


def pieces(batches, rows: int = 250):
    """Batches of at most ``rows`` rows: bounds the tokens held at once.  What a
    piece has used goes back to the system before the next."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
            pa.default_memory_pool().release_unused()


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over all rows of ``docs`` (text)."""
    def run(batches):
        for b in pieces(batches, 2000):
            got = pc.value_counts(word_lists(b.column("text"))[0])
            yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["token", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([b.num_rows], pa.int64())], ["token", "c"])

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


# -- the neural model: ids are the frequent words, the endings, other rare words, and last the start -------------------

def ending(word: str) -> str:
    return word[-2:]


def model_ids(tokens: pa.Array, words: pa.Array, endings: pa.Array) -> np.ndarray:
    """The class of every token."""
    place = pc.index_in(tokens, words)
    ids = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rare = place.is_null()
    last = pc.utf8_slice_codeunits(tokens.filter(rare), -2)
    ids[rare.to_numpy(zero_copy_only=False)] = len(words) + pc.fill_null(
        pc.index_in(last, endings), len(endings)).to_numpy(zero_copy_only=False)
    return ids


def start_parameters(unigram: np.ndarray, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The common starting point: small random vectors, unigram biases."""
    rng = np.random.default_rng(SEED)
    k = len(unigram)
    return {"r1": rng.normal(0, 0.1, (k + 1, dimensions)).astype(np.float32),
            "r2": rng.normal(0, 0.1, (k + 1, dimensions)).astype(np.float32),
            "c1": np.eye(dimensions, dtype=np.float32), "c2": np.eye(dimensions, dtype=np.float32),
            "q": rng.normal(0, 0.1, (k, dimensions)).astype(np.float32),
            "b": np.log(unigram).astype(np.float32)}


def _rows(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` by id."""
    return np.stack([np.bincount(ids, weights=rows[:, d], minlength=size) for d in range(rows.shape[1])], axis=1)


def nce_step(m: dict, squares: dict, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, noise: np.ndarray,
             logp: np.ndarray, rate: float = RATE) -> None:
    """One noise-contrastive step with AdaGrad scaling.  ``noise`` ids are
    shared by the batch; the classifier tells the data word from len(noise)
    draws of the unigram."""
    n, k = len(w), len(noise)
    h1, h2 = m["r1"][w1], m["r2"][w2]
    h = h1 @ m["c1"] + h2 @ m["c2"]
    qw, qn = m["q"][w], m["q"][noise]
    data = (h * qw).sum(1) + m["b"][w] - logp[w] - np.log(k)
    fake = h @ qn.T + (m["b"][noise] - logp[noise] - np.log(k))[None, :]
    gd = -1 / (1 + np.exp(np.clip(data, -30, 30)))            # d loss / d score of the data word
    gf = 1 / (1 + np.exp(-np.clip(fake, -30, 30)))            # and of the noise words
    gh = gd[:, None] * qw + gf @ qn
    size = len(logp)
    gradient = {
        "q": _rows(w, gd[:, None] * h, size) + _rows(noise, gf.T @ h, size),
        "b": np.bincount(w, weights=gd, minlength=size) + np.bincount(noise, weights=gf.sum(0), minlength=size),
        "r1": _rows(w1, gh @ m["c1"].T, size + 1), "r2": _rows(w2, gh @ m["c2"].T, size + 1),
        "c1": h1.T @ gh, "c2": h2.T @ gh}
    for x, g in gradient.items():
        g = (g / n).astype(np.float32)
        squares[x] += g * g
        m[x] -= rate * g / np.sqrt(squares[x])


def contexts(ids: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two places before each token; ``start`` before a text's first."""
    first = np.cumsum(lengths) - lengths
    one, two = np.roll(ids, 1), np.roll(ids, 2)
    one[first] = start
    two[first] = start
    second = first[lengths > 1] + 1
    two[second] = start
    return one, two


def train(docs: DataFrame, vocabulary: list[str], endings: list[str], unigram: np.ndarray) -> dict[str, np.ndarray]:
    """Average of the parameters that the partitions of ``docs`` reach."""
    start = start_parameters(unigram)
    names = sorted(start)
    k = len(unigram)
    logp = np.log(unigram).astype(np.float32)

    def run(batches):
        model = {x: v.copy() for x, v in start.items()}
        squares = {x: np.full_like(v, 1e-8) for x, v in start.items()}
        words, ends = pa.array(vocabulary, pa.string()), pa.array(endings, pa.string())
        rng, seen = np.random.default_rng(SEED), 0
        for b in pieces(batches):
            tokens, lengths = token_lists(b.column("text"))
            ids = model_ids(tokens, words, ends)
            one, two = contexts(ids, lengths, k)
            for at in range(0, len(ids), BATCH):
                s = slice(at, at + BATCH)
                noise = rng.choice(k, size=NOISE, p=unigram)
                nce_step(model, squares, one[s], two[s], ids[s], noise, logp)
            seen += len(ids)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()),
                 pa.array([[model[x].ravel().astype(np.float64) for x in names]], pa.list_(pa.list_(pa.float64())))],
                ["seen", "parameters"])

    parts = docs.select("text").mapInArrow(run, "seen long, parameters array<array<double>>")
    # weighted sums per parameter, added up by Spark: one row per entry reaches the driver
    entries = parts.select("seen", F.posexplode("parameters").alias("p", "values")).select(
        "seen", "p", F.posexplode("values").alias("i", "x"))
    total = entries.groupBy("p", "i").agg((F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).alias("x")).toPandas()
    out = {}
    for p, x in enumerate(names):
        own = total[total["p"] == p].sort_values("i")
        out[x] = own["x"].to_numpy(np.float32).reshape(start[x].shape) if len(own) else start[x]
    return out


def log_tables(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Tables of natural logs: ``a1[w1, w]``, ``a2[w2, w]`` (bias included) and
    the log partition function ``z[w1, w2]``, by batched matrix products."""
    h1, h2 = m["r1"] @ m["c1"], m["r2"] @ m["c2"]
    a1, a2 = h1 @ m["q"].T, h2 @ m["q"].T + m["b"][None, :]
    z = np.empty((len(h1), len(h2)), dtype=np.float32)
    e1, e2 = np.exp(a1 - a1.max(1, keepdims=True)), np.exp(a2 - a2.max(1, keepdims=True))
    z[:] = np.log(e1 @ e2.T) + a1.max(1)[:, None] + a2.max(1)[None, :]
    return {"a1": a1.astype(np.float32), "a2": a2.astype(np.float32), "z": z}


def score(docs: DataFrame, modulus: int = 7, held: int = 2, model_words: int = MODEL_WORDS, head: int = HEAD,
          endings: int = ENDINGS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "text")
    counts = keep(count_tokens(rows.where(~F.col("held_out"))), "counts")
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = total[0] or 0, total[1]
    # the least count whose tokens, with all more frequent ones, are at most ``head``: the
    # bound on what is collected and broadcast (there are under sqrt(2 N) different counts)
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    so_many = F.sum("k").over(Window.orderBy(F.desc("c")))
    floor = by_count.withColumn("so_many", so_many).where(F.col("so_many") <= head).agg(F.min("c")).first()[0]
    frequent = counts.where(F.col("c") >= floor).collect() if floor is not None else []
    top = sorted(((r["token"], r["c"]) for r in frequent), key=lambda x: (-x[1], x[0]))
    known = [t for t, _ in top[:model_words]]
    top_c = np.array([c for _, c in top], dtype=np.float64)
    model_c = top_c[:len(known)]
    # the rarer words by ending: at most ``endings`` rows
    rare = counts.join(F.broadcast(spark.createDataFrame([(t,) for t in known], "token string")), "token", "left_anti")
    by_ending = rare.groupBy(F.right("token", F.lit(2)).alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    classes = by_ending.orderBy(F.desc("c"), "e").limit(endings).collect()
    names = [r["e"] for r in classes]
    class_n = np.array([r["c"] for r in classes] + [0], dtype=np.int64)
    class_v = np.array([r["v"] for r in classes] + [0], dtype=np.int64)
    class_n[-1], class_v[-1] = n - int(model_c.sum()) - class_n.sum(), v - len(known) - class_v.sum()
    unigram = np.append(model_c, class_n) + 1.0
    unigram /= unigram.sum()
    model = train(rows.where(~F.col("held_out")), known, names, unigram)
    number = {e: i for i, e in enumerate(names)}
    # the class of every token of the head
    top_class = np.array([i if i < len(known) else len(known) + number.get(ending(t), len(names))
                          for i, (t, _) in enumerate(top)], dtype=np.int64)
    shared = spark.sparkContext.broadcast((pa.array([t for t, _ in top], pa.string()), top_c, top_class,
                                           pa.array(names, pa.string()), log_tables(model)))
    k, k_all = len(known), len(unigram)
    share = np.log10(class_n + class_v + 1.0)

    def run(batches):
        words, c, classes_of, ends, t = shared.value
        log_c = np.append(np.log10(c + 1), 0.0)
        for b in pieces(batches):
            tokens, lengths = token_lists(b.column("text"))
            place = pc.index_in(tokens, words)
            ids = pc.fill_null(place, len(c)).to_numpy(zero_copy_only=False).astype(np.int64)
            is_head = ids < len(c)
            own = np.append(classes_of, 0)[ids]
            last = pc.utf8_slice_codeunits(tokens.filter(place.is_null()), -2)
            own[~is_head] = k + pc.fill_null(pc.index_in(last, ends), len(ends)).to_numpy(zero_copy_only=False)
            one, two = contexts(own, lengths, k_all)
            p = (t["a1"][one, own] + t["a2"][two, own] - t["z"][one, two]).astype(np.float64) / np.log(10)
            first = np.cumsum(lengths) - lengths
            is_rare = own >= k
            # a rarer word's log10(c + 1) is added by the join unless it is in the head
            p += np.where(is_rare, log_c[ids] - share[np.maximum(own - k, 0)], 0.0)
            tail = tokens.filter(pa.array(~is_head))
            offsets = np.concatenate(([0], np.cumsum(np.add.reduceat(~is_head, first)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lengths),
                 pa.array(np.add.reduceat(is_head, first).astype(np.int64)),
                 pa.array(np.add.reduceat(log_c[ids], first)), pa.array(np.add.reduceat(p, first)),
                 pa.ListArray.from_arrays(pa.array(offsets), tail)],
                ["doc_id", "held_out", "n_tokens", "head_known", "head_log", "p", "tail"])

    schema = rows.drop("text").withColumns({
        "n_tokens": F.lit(0).cast("long"), "head_known": F.lit(0).cast("long"), "head_log": F.lit(0.0),
        "p": F.lit(0.0), "tail": F.array().cast("array<string>")}).schema
    parts = keep(rows.mapInArrow(run, schema).withColumn("__id", F.monotonically_increasing_id()), "scores")
    # rarer words: those seen in training add log10(c + 1) to their document
    tails = parts.select("__id", F.explode("tail").alias("token"))
    beyond = counts.where(F.col("c") < floor) if floor is not None else counts
    added = tails.join(beyond, "token").groupBy("__id").agg(
        F.count(F.lit(1)).alias("t_known"), F.sum(F.log10(F.col("c") + 1)).alias("t_log"))
    out = parts.drop("tail").join(added, "__id", "left")
    t_log = F.coalesce("t_log", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + t_log - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("p") + t_log).alias("score"))
