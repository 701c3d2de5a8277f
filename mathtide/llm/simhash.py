"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprint: 64 bits over the XXH64 values (seed 42) of word shingles of the
A-Z-lower-cased text, repeats included; a bit is 1 if set in over half of them.
A text with fewer words than a shingle is one shingle; without words it is 0.

Links: fingerprints at 3 or fewer differing bits.  The 64 bits are cut into
three segments (22, 21, 21 bits), each read as a word of the perfect binary
Golay code [23, 12, 7].  Three errors over three segments leave at least two
segments with one error or none, so a linked pair agrees up to one bit in both
segments of some pair of segments.  A segment is decoded to its codeword's
12-bit index; decoding every word at distance 0 or 1 from it gives its several
nearby indices (1 if the codeword is at distance 2 or less, up to 6 otherwise).
If two segments differ in one bit, the decoded index of one is among the nearby
indices of the other.  Each distinct fingerprint is stored under its 3 decoded
index pairs and probes with all its nearby index pairs; an equi-join finds the
candidates and keeps those within the distance.  No key has a size limit, and
equal fingerprints are one row, so copies never meet each other in the join.

Groups are connected components over distinct fingerprints by repeated
minimum-neighbour steps with pointer jumping, each round checkpointed.

Nulls: a null text is the empty text; a null doc_id is carried, and is its
component's id only if all of the component's are null.  Repeated rows each
get a row.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import keep

SHINGLE = 3
DISTANCE = 3
SEED = 42
# the generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))      # (lowest bit, bits)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()     # bytes.lower() is A-Z only
    if not w:
        return 0
    if len(w) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    else:
        joined = b" ".join(w)
        ends = np.cumsum([len(x) + 1 for x in w])
        starts = np.concatenate(([0], ends[:-1])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends - 1).tolist()[shingle - 1:])]
    counts = np.zeros(64, dtype=np.int64)
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(h), 1 << 16):       # bounded memory for very long texts
        counts += np.unpackbits(h[i:i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``columns`` of ``docs`` and ``fp``, the fingerprint's bits as a long."""
    rows = docs.select(*columns, "text")
    schema = rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(fp)], [*columns, "fp"])

    return rows.mapInArrow(run, schema)


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    r = words.copy()
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def _error_table() -> np.ndarray:
    """Error pattern of weight 3 or less for every remainder: the code is
    perfect, so each of the 2048 remainders has exactly one."""
    one = 1 << np.arange(23)
    patterns = {0}
    for _ in range(3):
        patterns |= {p | int(b) for p in patterns for b in one}
    patterns = np.array(sorted(patterns), dtype=np.int64)
    table = np.zeros(2048, dtype=np.int64)
    table[_remainder(patterns)] = patterns
    return table


def decode(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords nearest to 23-bit words."""
    return (words ^ errors[_remainder(words)]) >> 11


def _index_pairs(fp: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per fingerprint its 3 stored keys and the arrays of its probe keys."""
    own, near = [], []
    for low, bits in SEGMENTS:
        seg = ((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        ball = np.concatenate((np.zeros(1, dtype=np.int64), 1 << np.arange(bits, dtype=np.int64)))
        found = decode((seg[:, None] ^ ball[None, :]).ravel(), errors).reshape(len(fp), -1)
        own.append(found[:, 0])
        near.append([np.unique(x) for x in found])
    pairs = ((0, 1), (0, 2), (1, 2))
    stored = np.stack([(k << 24) | (own[a] << 12) | own[b] for k, (a, b) in enumerate(pairs)], axis=1)
    probes = [np.concatenate([((k << 24) | (near[a][i][:, None] << 12) | near[b][i][None, :]).ravel()
                              for k, (a, b) in enumerate(pairs)]) for i in range(len(fp))]
    return stored, probes


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column ``fp`` that
    differ in ``distance`` bits or fewer; ``distance`` may be 0 to 3."""
    if not 0 <= distance <= 3:
        raise ValueError("three segments guarantee distances up to 3")
    errors = _error_table()

    def keys(probe):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    fp = b.column("fp").slice(at, 2000).to_numpy(zero_copy_only=False).astype("<i8")
                    stored, probes = _index_pairs(fp.view("<u8"), errors)
                    if probe:
                        key, times = np.concatenate(probes), [len(x) for x in probes]
                    else:
                        key, times = stored.ravel(), 3
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(fp, times))], ["key", "fp"])
        return run

    stored = distinct.select("fp").mapInArrow(keys(False), "key long, fp long").withColumnRenamed("fp", "a")
    probes = distinct.select("fp").mapInArrow(keys(True), "key long, fp long").withColumnRenamed("fp", "b")
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    found = stored.join(probes.hint("merge"), (stored["key"] == probes["key"]) & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of every node's component, for all nodes of
    ``edges`` (a, b).  Each round every node takes the least root seen over its
    edges, then its root's root; rounds are about the logarithm of the longest
    shortest path.  Nothing but one count per round reaches the driver."""
    both = keep(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b"), F.col("a"))), "edges")
    roots = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("root"))
    roots = keep(roots, "roots")
    while True:
        # the least root among the neighbours reaches the node and the node's old root
        seen = both.join(roots.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("root").alias("m"))
        step = roots.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("new"))
        hooked = step.groupBy(F.col("old").alias("node")).agg(F.min("new").alias("hook"))
        step = step.select("node", "old", "new").unionByName(
            hooked.select("node", F.col("node").alias("old"), F.col("hook").alias("new")))
        step = step.groupBy("node").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        jumped = step.join(step.select(F.col("node").alias("new"), F.col("new").alias("up")), "new").select(
            "node", F.least("new", "up").alias("root"), (F.least("new", "up") < F.col("old")).alias("moved"))
        jumped = keep(jumped, "roots")
        roots = jumped.select("node", "root")
        if jumped.where("moved").limit(1).count() == 0:
            return roots


def grouped(prints: DataFrame, id_column: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``prints``:
    its group's least fingerprint, and the least ``id_column`` of the group."""
    distinct = keep(prints.groupBy("fp").agg(F.min(id_column).alias("least")), "distinct")
    roots = components(links(distinct, distance)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "root", "component_id")
    alone = distinct.join(roots.select("fp"), "fp", "left_anti").select(
        "fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = keep(fingerprints(docs, shingle=shingle), "prints")
    return prints.join(grouped(prints, distance=distance), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Places (__file, __pos) of the one row of ``docs`` (with both columns) kept
    of each group: the least doc_id, nulls last, then the first place.  A group
    of any size is reduced where its rows lie, by a partial aggregate."""
    prints = keep(fingerprints(docs, ("doc_id", "__file", "__pos"), shingle), "prints")
    rows = prints.join(grouped(prints, distance=distance).select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__file", "__pos")
    return rows.groupBy("root").agg(F.min_by(F.struct("__file", "__pos"), order).alias("kept")).select("kept.*")
