"""Token-id output in training order.

Every document becomes token ids and one end token, cut into sequences of
``SEQUENCE`` ids, the last padded.  The default tokens are UTF-8 bytes as uint8
ids, with 255 as end and 254 as padding, two bytes that UTF-8 never uses, so
texts come back exactly; ``bpe`` reads a public byte-pair rank file instead and
writes uint16 or uint32 ids.

Sequences are numbered 0 .. n-1 as they lie in the stored table (file name, row,
place in the document).  A keyed Feistel network over the least even number of
bits that holds n permutes the numbers, walking the cycle until it is back below
n; the image is a sequence's global slot.  Shard k holds slots k * per_shard ..
and is one file of fixed-stride records: the record of a slot starts at
(slot mod per_shard) * stride, so a reader resumes from a slot number alone.

Two passes over the table: the first counts sequences of each run of rows (one
small row per file split), the second writes.  Runs are found by file and row
number, so their order, and every slot, is the same at any split size and on
any cluster.  Only the payload is shuffled, once, by shard: records that go from
one batch of documents to the same shard travel as one compressed block.  The
writer puts a shard's records (at most MOST_RECORDS) into place, writes them to
a temporary name in the shared folder and renames it, so a lost executor's work
is simply done again.

Nulls: a null text is empty: one sequence of an end token.  A null doc_id is
carried.  Repeated rows are sequences of their own.  An empty table writes no
shard.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import stored
from mathtide.session import scratch_path

SEQUENCE = 512
LEAST_SHARDS = 256           # shards of a small output; a large one has more
MOST_RECORDS = 1 << 18       # records in a shard at most
KEY = "training-order-1"
ROUNDS = 6


# -- permutation --------------------------------------------------------------------------------------------------------

def round_keys(key: str, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(rounds)]


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit mixing function of the half-word and a round key."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(k)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slots(numbers: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """The permutation of 0 .. n-1: Feistel network with cycle walking."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def network(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << shift) | right

    out = network(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():       # the domain is under 4 n: few rounds
        out[outside] = network(out[outside])
    return out.astype(np.int64)


# -- tokens -------------------------------------------------------------------------------------------------------------

class ByteTokens:
    """UTF-8 bytes; 255 ends a document, 254 pads."""

    dtype, end, pad = np.dtype("uint8"), 255, 254

    def encoder(self) -> Callable[[str], np.ndarray]:
        return lambda text: np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


class BpeTokens:
    """Byte-pair ids from a rank file ('base64 rank' lines) and its split
    pattern; the next free ids are end and padding."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.pattern = pattern
        self.end = max(self.ranks.values()) + 1
        self.pad = self.end + 1
        self.dtype = np.dtype("<u2" if self.pad < 1 << 16 else "<u4")

    def encoder(self) -> Callable[[str], np.ndarray]:
        import tiktoken
        enc = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return lambda text: np.array(enc.encode_ordinary(text), dtype=self.dtype)


def sequences(text: str | None, encode, tokens, length: int) -> tuple[np.ndarray, int]:
    """(records x length ids, number of real ids incl. the end token)."""
    ids = encode(text or "")
    n = len(ids) + 1
    out = np.full(-(-n // length) * length, tokens.pad, dtype=tokens.dtype)
    out[:n - 1] = ids
    out[n - 1] = tokens.end
    return out.reshape(-1, length), n


# -- files --------------------------------------------------------------------------------------------------------------

def file_system(folder: str):
    """(pyarrow file system, path) of a folder in shared storage."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialise(docs: DataFrame, folder: str | None = None, tokens=None, length: int = SEQUENCE, key: str = KEY,
                least_shards: int = LEAST_SHARDS, most_records: int = MOST_RECORDS) -> DataFrame:
    """Write the shards below ``folder`` (default: a new one in the shared
    checkpoint folder) and return one row per sequence: doc_id, seq_no,
    n_tokens, slot, shard, byte_offset, crc32 (of the record), path."""
    spark = docs.sparkSession
    tokens = tokens or ByteTokens()
    folder = folder or scratch_path(spark, "tokens")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    rows = stored(docs).select("doc_id", "text", "__file", "__pos")
    stride = length * tokens.dtype.itemsize

    def runs(batches):
        """(file, first row, sequences) of every run of rows as they follow in a file."""
        encode, file, first, last, count = tokens.encoder(), None, 0, -2, 0
        found = []
        for b in batches:
            if isinstance(tokens, ByteTokens):
                sizes = b.column("size").to_numpy(zero_copy_only=False) + 1
            else:
                sizes = np.array([len(encode(t.as_py() or "")) + 1 for t in b.column("text")])
            for f, pos, n in zip(b.column("__file").to_pylist(), b.column("__pos").to_pylist(), sizes.tolist()):
                if f != file or pos <= last:
                    if file is not None:
                        found.append((file, first, count))
                    file, first, count = f, pos, 0
                last, count = pos, count + -(-n // length)
        if file is not None:
            found.append((file, first, count))
        yield pa.RecordBatch.from_pylist([{"file": f, "first": a, "n": c} for f, a, c in found],
                                         schema=pa.schema([("file", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # byte tokens are counted in the JVM; the text itself stays there
    narrow = rows.select("__file", "__pos", F.octet_length(text).cast("long").alias("size")) \
        if isinstance(tokens, ByteTokens) else rows.select("__file", "__pos", "text")
    # one row per run: about one per file split
    parts = sorted(tuple(r) for r in narrow.mapInArrow(runs, "file string, first long, n long").toLocalIterator())
    starts, total = {}, 0
    for f, a, n in parts:
        starts.setdefault(f, []).append((a, total))
        total += n
    per_shard = max(1, min(most_records, -(-total // least_shards)))
    keys = round_keys(key)
    shared = spark.sparkContext.broadcast({f: np.array(v, dtype=np.int64) for f, v in starts.items()})
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        """Blocks of sequences for a shard; numbers run on within a run of rows."""
        encode, file, last, number = tokens.encoder(), None, -2, 0
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                piece = b.slice(at, 500)
                rows_of, numbers, seq, sizes, data = [], [], [], [], []
                for k, (f, pos, t) in enumerate(zip(piece.column("__file").to_pylist(),
                                                    piece.column("__pos").to_pylist(), piece.column("text"))):
                    if f != file or pos <= last:
                        file, at_run = f, shared.value[f]
                        where = int(np.searchsorted(at_run[:, 0], pos))
                        if where == len(at_run) or at_run[where, 0] != pos:
                            raise RuntimeError("the table was split otherwise in the first pass")
                        number = int(at_run[where, 1])
                    last = pos
                    records, n = sequences(t.as_py(), encode, tokens, length)
                    count = len(records)
                    rows_of.append(np.full(count, k))
                    numbers.append(np.arange(number, number + count))
                    seq.append(np.arange(count))
                    sizes.append(np.minimum(length, n - np.arange(count) * length))
                    data.append(records)
                    number += count
                slot = slots(np.concatenate(numbers), total, keys)
                order = np.argsort(slot, kind="stable")
                slot, records = slot[order], np.concatenate(data)[order]
                shards, first = np.unique(slot // per_shard, return_index=True)
                ends = np.append(first, len(slot))
                offsets = pa.array(ends.astype(np.int32))

                def lists(values):
                    return pa.ListArray.from_arrays(offsets, values)

                ids = piece.column("doc_id").take(pa.array(np.concatenate(rows_of)[order]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards), lists(pa.array(slot)), lists(ids),
                     lists(pa.array(np.concatenate(seq)[order].astype(np.int32))),
                     lists(pa.array(np.concatenate(sizes)[order].astype(np.int32))),
                     pa.array([pack.compress(records[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])], pa.binary())],
                    ["shard", "slots", "ids", "seqs", "sizes", "block"])

    def write(batches):
        """Write every shard from its blocks; a shard's blocks come together."""
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        unpack, shard, held = zstandard.ZstdDecompressor(), None, []

        def finish():
            slot = np.concatenate([h[0] for h in held])
            order = np.argsort(slot, kind="stable")
            records = np.concatenate([np.frombuffer(unpack.decompress(h[4]), dtype=tokens.dtype).reshape(-1, length)
                                      for h in held])[order]
            temporary = f"{base}/.{shard_name(shard)}-{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(records.tobytes())
            store.move(temporary, f"{base}/{shard_name(shard)}")
            n = len(slot)
            ids = pa.concat_arrays([h[1] for h in held]).take(pa.array(order))
            numbers = [np.concatenate([h[k] for h in held])[order] for k in (2, 3)]
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(numbers[0], pa.int32()), pa.array(numbers[1], pa.int32()), pa.array(slot[order]),
                 pa.array(np.full(n, shard)), pa.array(slot[order] % per_shard * stride),
                 pa.array([zlib.crc32(r.tobytes()) for r in records], pa.int64()),
                 pa.array([f"{folder}/{shard_name(shard)}"] * n, pa.string())],
                ["doc_id", "seq_no", "n_tokens", "slot", "shard", "byte_offset", "crc32", "path"])

        for b in batches:
            for k in range(b.num_rows):
                this = b.column("shard")[k].as_py()
                if held and this != shard:
                    yield finish()
                    held = []
                shard = this
                held.append((b.column("slots")[k].values.to_numpy(), b.column("ids")[k].values,
                             b.column("seqs")[k].values.to_numpy(), b.column("sizes")[k].values.to_numpy(),
                             b.column("block")[k].as_py()))
        if held:
            yield finish()

    dealt = rows.select("doc_id", "text", "__file", "__pos").mapInArrow(
        cut, f"shard long, slots array<long>, ids array<{id_type}>, seqs array<int>, sizes array<int>, block binary")
    # a shard's records meet in one task: at most MOST_RECORDS of them; the tasks follow the full shards
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most_records), 1)
    dealt = dealt.repartition(tasks, "shard") \
        .sortWithinPartitions("shard")
    return dealt.mapInArrow(write, f"doc_id {id_type}, seq_no int, n_tokens int, slot long, shard long, "
                                   "byte_offset long, crc32 long, path string")


def read_records(folder: str, shard: int, first: int, count: int, length: int = SEQUENCE, tokens=None) -> np.ndarray:
    """``count`` records of a shard from its record ``first`` on: one seek."""
    tokens = tokens or ByteTokens()
    store, base = file_system(folder)
    stride = length * tokens.dtype.itemsize
    with store.open_input_file(f"{base}/{shard_name(shard)}") as f:
        return np.frombuffer(f.read_at(count * stride, first * stride), dtype=tokens.dtype).reshape(-1, length)
