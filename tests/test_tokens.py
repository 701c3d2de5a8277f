"""Vocabulary, encode (padded / unpadded), labels, budget."""

from pyspark.sql import functions as F

from mathtide.operators import tokens as T


def test_encode_shapes(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a"), (3, ""), (4, None)], "id long, text string")
    vocab = T.fit_vocabulary(docs, "text", 5)
    ids = {r.token: r.id for r in vocab.collect()}
    assert ids == {"a": 3, "b": 4}                  # specials 0-2, then by count, ties by token
    out = {r.id: r for r in T.encode(docs, vocab, "text", 3, pad=True, n_input_col="n").collect()}
    assert out[1].input_ids == [3, 4, 3] and out[1].attention_mask == [1, 1, 1] and out[1].n == 4
    assert out[2].input_ids == [3, 0, 0] and out[2].attention_mask == [1, 0, 0]
    assert out[3].input_ids == [0, 0, 0]
    raw = {r.id: r.input_ids for r in T.encode(docs, vocab, "text", 3, pad=False).collect()}
    assert raw[1] == [3, 4, 3] and raw[2] == [3] and raw[3] == []
    assert "text" not in T.encode(docs, vocab, "text", 3).columns


def test_labels_and_budget(spark):
    df = spark.createDataFrame([([5, 6, 0], [1, 1, 0], 1000)], "input_ids array<int>, attention_mask array<int>, n int")
    r = df.select(T.causal_labels().alias("l"),
                  T.token_budget(F.col("n"), "gpt2", 512).alias("g"),
                  T.token_budget(F.col("n"), "deepseek-r1", 512).alias("d"),
                  T.token_budget(F.col("n"), "mistral", 4096).alias("m"),
                  T.token_budget(F.col("n"), "gpt2", 512, max_context=3000).alias("c")).first()
    assert r.l == [5, 6, -100]
    assert (r.g, r.d, r.m, r.c) == (24, 512, 1048, 512)


def test_arrow_tokens_equal_jvm_rule(spark):
    import pyarrow as pa
    texts = ["Héllo, wörld!! a_b 12.5\tx\x0by z", "", None, "¿Qué? ... ok\n\nEnd", "ｘ　ｙ", "a b"]
    jvm = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string")
           .select(T.tokens("t")).collect()]
    arrow = T.arrow_token_lists(pa.array(texts, pa.string())).to_pylist()
    assert [j if j is not None else [] for j in jvm] == arrow
