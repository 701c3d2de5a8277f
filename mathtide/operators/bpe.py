"""B13 with a public byte-level byte-pair vocabulary: encode and decode.

The vocabulary is a ``tokenizers`` JSON file named by its path, which every
executor can read; nothing is trained.  A byte-level vocabulary has an id for every
byte, so any text has ids and decoding gives the text back.

Ids are those of the ``tokenizers`` library without added special tokens.  They are
made by the ``tiktoken`` encoder from the same vocabulary and split pattern, in a
quarter of the time; texts that hold the string of a special token go through ``tokenizers``
itself, which reads it as that token.  A test compares both.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE = 256          # texts encoded at a time


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids and bytes of a byte-level byte-pair vocabulary file."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark's tasks are the parallelism
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in self.special}
        self.fast = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def text(self, ids: list[int]) -> str:
        """The text of ids; a character cut by truncation becomes U+FFFD."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


def encode_bpe(df: DataFrame, path: str, text: str = "text", max_length: int | None = 1024, pad: bool = True,
               pad_id: int | None = None, ids_col: str = "input_ids", mask_col: str = "attention_mask",
               keep_text: bool = False, n_input_col: str | None = None) -> DataFrame:
    """Ids truncated to ``max_length`` (None: whole), and padded to it when
    ``pad``, with the attention mask; ``pad_id`` defaults to the vocabulary's last special token, as end-of-text
    is used for padding.  A null text has no ids.  ``n_input_col`` adds the untruncated number of ids.  A batch
    (or frame) at a time in Arrow, also on a stream."""
    if pad and not max_length:
        raise ValueError("padding needs max_length")
    out_fields = [f for f in df.schema.fields if keep_text or f.name != text]
    out_names = [f.name for f in out_fields]
    extra = [T.StructField(n_input_col, T.IntegerType())] if n_input_col else []
    lists = [T.StructField(c, T.ArrayType(T.IntegerType()), False) for c in (ids_col, mask_col)]

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        vocabulary = Vocabulary(path)
        fill = max(vocabulary.special.values()) if pad and pad_id is None else pad_id
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                found = [np.array(vocabulary.ids(t) if t is not None else [], dtype=np.int32)
                         for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                counts = pa.array([len(x) for x in found], pa.int32())
                found = [x[:max_length] for x in found]
                sizes = np.array([len(x) for x in found])
                if pad:
                    ids = np.full((len(found), max_length), fill, dtype=np.int32)
                    for k, x in enumerate(found):
                        ids[k, :len(x)] = x
                    mask = (np.arange(max_length) < sizes[:, None]).astype(np.int32).ravel()
                    ids, ends = ids.ravel(), np.arange(len(found) + 1) * max_length
                else:
                    ids, ends = np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)])
                    mask = np.ones(len(ids), dtype=np.int32)
                offsets = pa.array(ends.astype(np.int32))
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in out_names]
                arrays += [counts] * len(extra)
                arrays += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, mask)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*out_names, *[f.name for f in extra], ids_col, mask_col])

    return df.mapInArrow(encode, T.StructType([*out_fields, *extra, *lists]))


def decode_bpe(df: DataFrame, path: str, ids_col: str = "input_ids", text_col: str = "text",
               mask_col: str | None = "attention_mask") -> DataFrame:
    """The text of ``ids_col`` in place of it (and of the mask): positions whose
    mask is 0 are left out."""
    masks = [mask_col] if mask_col else []
    out_fields = [f for f in df.schema.fields if f.name not in (ids_col, *masks, text_col)]
    out_names = [f.name for f in out_fields]

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        vocabulary = Vocabulary(path)
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
                if mask_col:
                    masked = batch.column(batch.schema.get_field_index(mask_col)).to_pylist()
                    ids = [[i for i, m in zip(x or [], y or []) if m] for x, y in zip(ids, masked)]
                texts = pa.array([vocabulary.text(x or []) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(c)) for c in out_names], texts], names=[*out_names, text_col])

    return df.mapInArrow(decode, T.StructType([*out_fields, T.StructField(text_col, T.StringType())]))
