"""Fits that stay bounded, ids of any type, columns with clashing names, hot ties."""
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from mathtide.llm import mixing, quality_classifier, toxicity
from mathtide.llm.common import labelled_texts


def repeated(documents, labels):
    """One labelled id 3,000 times, with two texts."""
    one = labels.join(documents.select("doc_id"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 20 == 1)
    doc = one.select(F.min("doc_id")).first()[0]
    extra = documents.where(F.col("doc_id") == doc).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3000)))) \
        .withColumn("text", F.when(F.col("copy") % 2 == 0, "short.").otherwise(F.col("text"))).drop("copy")
    return documents.union(extra), doc


def test_a_repeated_id_is_one_row_of_the_fit(documents, labels, monkeypatch):
    docs, doc = repeated(documents, labels)
    chosen = quality_classifier.sample_labels(labels, "toxic", 5, 0, 8000)
    rows = labelled_texts(docs, chosen).collect()
    assert len({(r["doc_id"], r["y"]) for r in rows}) == len(rows) <= documents.count()
    fitted = []
    train, extract = toxicity.train, quality_classifier.extract_rules
    monkeypatch.setattr(toxicity, "train", lambda y, *a, **k: fitted.append(len(y)) or train(y, *a, **k))
    monkeypatch.setattr(quality_classifier, "extract_rules", lambda x, y: fitted.append(len(y)) or extract(x, y))
    toxicity.fit(docs, labels)
    quality_classifier.fit(docs, labels)
    assert fitted and max(fitted) <= documents.count()


def test_text_ids(documents_mid, labels):
    """Ids as texts give the scores of ids as numbers."""
    plain = {str(r["doc_id"]): r["score"] for r in toxicity.score(documents_mid, labels).collect()}
    text = toxicity.score(documents_mid.withColumn("doc_id", F.col("doc_id").cast("string")),
                          labels.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert {r["doc_id"]: r["score"] for r in text.collect()} == plain


def test_noisy_or_by_definition():
    """The score is one minus the product over sentences of 1 - p(sentence)."""
    weights = {"bad": 2.5, "^awf": 1.5, "fine": -1.0}
    texts = ["A bad one. And awful! fine", "", None, "...", "no word known", "bad\nbad bad. awfully fine?", "x " * 500 + "bad."]
    for text in texts:
        rest = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            words = set(re.findall(r"\w+", sentence.lower()))
            if words:
                found = {f for w in words for f in [w, *["^" + w[:k] for k in range(3, 8) if len(w) > k]]}
                rest *= 1 - 1 / (1 + np.exp(-(sum(weights.get(f, 0.0) for f in found) - 2.0)))
        assert abs(toxicity.score_text(text, weights, -2.0)[0] - (1 - rest)) < 1e-12


def test_clashing_names_through_all_stages(spark, documents):
    own = {"__q_text": F.lit("a"), "__size": F.lit(1), "__score": F.lit("s"), "__file": F.lit("f"), "__pos": F.lit(-1),
           "__taken": F.lit(2), "__n": F.lit(3), "kept_0": F.lit("k"), "g": F.lit("g"), "fp": F.lit(0)}
    docs = documents.withColumns(own)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name == corpus_pipeline.STAGES[-1][0]:
            assert out.count() > 0
            break
        assert out.columns == docs.columns, name
        rows = out.select(*own).distinct().collect()
        assert [tuple(r) for r in rows] == [("a", 1, "s", "f", -1, 2, 3, "k", "g", 0)], name
        path = corpus_pipeline.keep(out, "clash").inputFiles()[0].rsplit("/", 1)[0]
        docs = spark.read.parquet(path)


def test_equal_rows_fall_into_different_slices(spark):
    """Rows without ids and of one size are ordered by their place."""
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two").alias("text"),
                                    F.lit("a").alias("source"))
    rows = mixing.mix(docs, share=0.5).collect()
    assert len(rows) == 3000 and sum(r["taken"] for r in rows) == 3000
    assert sorted({r["taken"] for r in rows}) == [0, 2]
