"""Byte-pair encoding with a public vocabulary, against the tokenizers library."""
import public_tokenizers
import pytest

from mathtide.operators import bpe
from mathtide.operators import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello world, it's 3.5!", "", None, " leading  and   trailing \n\n\t ", "漢字 und größer ½ 🙂", "a" * 3000,
         "x <|endoftext|> y", "\x00\x1f\x7f", "don't can't we'll I'd", "\u00a0\u2003nbsp\u3000"]


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id long, text string")


def test_ids_are_those_of_tokenizers(spark, exact):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = bpe.encode_bpe(docs, PATH, max_length=None, pad=False, keep_text=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.input_ids == exact.encode(r.text, add_special_tokens=False).ids
        assert r.attention_mask == [1] * len(r.input_ids)


def test_shapes(texts, exact):
    rows = {r.id: r for r in bpe.encode_bpe(texts, PATH, max_length=16, n_input_col="n").collect()}
    for k, t in enumerate(TEXTS):
        ids = exact.encode(t or "", add_special_tokens=False).ids
        got = rows[k]
        assert got.n == len(ids) and len(got.input_ids) == len(got.attention_mask) == 16
        assert got.input_ids == (ids + [50256] * 16)[:16]
        assert sum(got.attention_mask) == min(16, len(ids))
    labels = {r[0]: r[1] for r in bpe.encode_bpe(texts, PATH, max_length=16).select("id", T.causal_labels()).collect()}
    assert labels[1] == [-100] * 16
    assert "text" not in bpe.encode_bpe(texts, PATH).columns
    with pytest.raises(ValueError):
        bpe.encode_bpe(texts, PATH, max_length=None)


def test_decoding_gives_the_text_back(texts):
    padded = bpe.decode_bpe(bpe.encode_bpe(texts, PATH, max_length=4000), PATH)
    whole = bpe.decode_bpe(bpe.encode_bpe(texts, PATH, max_length=None, pad=False), PATH)
    for back in (padded, whole):
        assert {r.id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    assert bpe.encode_bpe(texts.where("id < 0"), PATH).count() == 0
