"""Sharding by longest processing time.

Documents with equal texts are one group and stay together.  Groups sorted by
size go, largest first, to the least loaded shard, kept in a heap.  A heap over
every group would be one process for the whole corpus, so groups below
1 / (32 x shards) of all bytes are first dealt by their text's hash into a fixed
number of bundles; the heap then handles at most 32 x shards single groups and
the bundles, whatever the input's size, and each of those items is whole.

Law ``bytes``: shard sizes near equal; a group larger than a fair share is the
only cause of a larger shard.  Nulls: a null text counts as the empty text (16
bytes, crc32 0, one group with empty texts); null doc_ids sort first.  An
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import stored, text_or_empty
from mathtide.operators.ranking import global_rank

SHARDS = 40
BUNDLES_PER_SHARD = 200
SINGLES_PER_SHARD = 32
ROW_BYTES = 16


def place(items: list[tuple[str, int]], shards: int) -> list[tuple[str, int]]:
    """Longest processing time: (item, size) -> (item, shard); ties by name."""
    heap = [(0, k) for k in range(shards)]
    out = []
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        out.append((name, k))
        heapq.heappush(heap, (load + size, k))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.
    Slots number a shard's rows from 0 by doc_id (then text hash, then place in the table)."""
    spark = docs.sparkSession
    text = text_or_empty()
    rows = stored(docs).select("doc_id", (F.octet_length(text) + row_bytes).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("__g"),
                       F.xxhash64("__file", "__pos").alias("__place"))
    groups = rows.groupBy("__g").agg(F.sum("size").alias("__bytes"))
    total = groups.agg(F.sum("__bytes")).first()[0] or 0
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("__g"), F.lit(BUNDLES_PER_SHARD * shards)).cast("string"))
    single = F.col("__bytes") * (SINGLES_PER_SHARD * shards) >= total
    loads = groups.groupBy(F.when(single, F.col("__g")).otherwise(bundle).alias("item")).agg(
        F.sum("__bytes").alias("bytes"), F.max(single).alias("single"))
    # at most 32 x shards singles (each holds that share of the bytes) and 200 x shards bundles
    items = [(r["item"], r["bytes"], r["single"]) for r in loads.toLocalIterator()]
    placed = dict(place([x[:2] for x in items], shards))
    schema = "{} string, {} int"
    singles = spark.createDataFrame([(x, placed[x]) for x, _, s in items if s], schema.format("__g", "__s1"))
    bundles = spark.createDataFrame([(x, placed[x]) for x, _, s in items if not s], schema.format("__b", "__s2"))
    dealt = (rows.join(F.broadcast(singles), "__g", "left").withColumn("__b", bundle)
             .join(F.broadcast(bundles), "__b", "left")
             .select("doc_id", "size", "text_crc32", "__g", "__place", F.coalesce("__s1", "__s2").alias("shard")))
    return global_rank(dealt, ["doc_id", "__g", "__place"], "slot", ["shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
