"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased, punctuation becomes blanks, and words make five-word
shingles hashed by xxhash64.  For an item of n words, every n-word window of a
document that puts some shingle shared with the item at that shingle's place in
the item gets a 64-bit SimHash over its shingles (a window similar to the item
shares at least one shingle with it, so windows elsewhere cannot qualify; where
shared shingles are displaced against each other by an edit, each displacement
is a window of its own).  Multi-index Hamming blocks find all windows within
``RADIUS`` = 23 bits of an item of the same length: 64 bits are eight blocks of
eight; at 23 errors or fewer some block has two or fewer, and every item stores
all values within two bits of each of its blocks.  Candidates within the radius
are verified by the exact weighted Jaccard similarity of the shingles (weight:
how often a shingle occurs), 0.8 or more.

To find shared shingles, a bitmap of the items' shingle hashes is tested first
inside each row, so only positions that may match leave the row, with the
hashes around them; the exact test is the join that follows.  Only DataFrame
functions run on this path.

The benchmark is the stated query set.  Its bitmap has a fixed size; its tables
are joined by whatever join Spark plans from their size.

Windows are told apart by their row's place in the stored files, so null and
repeated document ids are no problem; the ids come together in the last
aggregate only.

Nulls: a null text is empty; null ids are carried.  An item of fewer than five
words is one shingle; documents' runs of the lengths such items have are tested
through the same bitmap, the first place of each run.  Items without words match
nothing.  Repeated rows: every
(doc_id, item_id) is returned once.  Empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import BLANKS, keep, stored, text_or_empty, words

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_ERRORS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1
BITMAP_WORDS = 1 << 15          # longs: 2 M bits, 256 KB
PUNCTUATION = ".,;:!?\"'`()[]{}<>|*#$%&_=+~^/\\-"


def plain_words(text: Column) -> Column:
    blanks = PUNCTUATION + BLANKS
    return words(F.translate(F.lower(text), blanks, " " * len(blanks)))


def shingle_hashes(w: Column) -> Column:
    """xxhash64 of every run of SHINGLE words; fewer words are one run; none: none."""
    return F.when(F.size(w) >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).when(
        F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def _shiftleft(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits.cast("int"))


def simhash(h: Column) -> Column:
    """64 bits: set where over half of the hashes have the bit."""
    def bit(b):
        ones = F.aggregate(h, F.lit(0), lambda a, x: a + F.getbit(x, b))
        return F.when(2 * ones > F.size(h), _shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"),
                       lambda a, x: a.bitwiseOR(x))


def _occurrences(h: Column) -> Column:
    """Strings 'hash:k' for the k-th occurrence, so that multisets are sets."""
    s = F.array_sort(h)
    return F.transform(s, lambda x, i: F.concat_ws(":", x.cast("string"), (
        i + 1 - F.array_position(s, x)).cast("string")))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of hashes."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(
        F.size(F.array_intersect(_occurrences(a), _occurrences(b)))).cast("double")
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1.0))


def _block(fp: Column, k) -> Column:
    return F.shiftright(fp, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _near_values() -> list[int]:
    """Masks of up to BLOCK_ERRORS bits in a block."""
    return [sum(1 << b for b in c) for k in range(BLOCK_ERRORS + 1) for c in combinations(range(BLOCK_BITS), k)]


def find(docs: DataFrame, benchmark: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document (``key`` columns of ``docs``) and item found in it:
    similarity, distance and start (the word at which the window begins)."""
    if "__file" not in key:
        docs = stored(docs)
    row = tuple(dict.fromkeys((*key, "__file", "__pos")))
    items = benchmark.select("item_id", plain_words(text_or_empty()).alias("w")).where(F.size("w") > 0)
    items = keep(items.select("item_id", F.size("w").alias("n"), shingle_hashes(F.col("w")).alias("ih"))
                 .withColumn("ifp", simhash(F.col("ih"))), "items")
    grams = items.select("item_id", "n", F.posexplode("ih").alias("q", "g"))
    lengths = F.broadcast(items.agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest"),
                                    F.collect_set(F.when(F.col("n") < SHINGLE, F.col("n"))).alias("short")))
    # one row: the bitmap of all items' shingles
    place = F.pmod("g", F.lit(BITMAP_WORDS * 64))
    cells = grams.groupBy(F.shiftright(place, 6).alias("cell")).agg(
        F.bit_or(_shiftleft(F.lit(1).cast("long"), F.pmod("g", F.lit(64)))).alias("bits"))
    cell = F.struct("cell", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    bitmap = items.sparkSession.range(BITMAP_WORDS).withColumnRenamed("id", "cell").join(cells, "cell", "left").agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["bits"]).alias("bitmap"))
    # one row each: no cross products
    rows = docs.select(*row, plain_words(text_or_empty()).alias("w")).crossJoin(lengths)
    runs = F.transform("short", lambda n: F.struct(n.alias("n"), F.when(F.size("w") >= n, F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n)))).otherwise(
        F.array().cast("array<bigint>")).alias("h")))
    rows = rows.select(*row, "longest", F.size("w").alias("m"), shingle_hashes(F.col("w")).alias("h"),
                       runs.alias("runs")).crossJoin(F.broadcast(bitmap))

    def may_match(x):
        p = F.pmod(x, F.lit(BITMAP_WORDS * 64))
        cell = F.get(F.col("bitmap"), F.shiftright(p, 6).cast("int"))
        return F.getbit(cell, F.pmod(p, F.lit(64)).cast("int")) == 1

    positions = F.filter(F.transform(F.col("h"), lambda x, i: F.when(may_match(x), i)), lambda i: i.isNotNull())
    def place_of(p, g, n):
        return F.struct(p.cast("int").alias("p"), g.alias("g"), n.cast("int").alias("run"))

    whole = F.transform(positions, lambda p: place_of(p, F.get("h", p), F.lit(0)))
    short = F.flatten(F.transform("runs", lambda x: F.transform(
        F.filter(F.array_distinct(x["h"]), may_match), lambda g: place_of(F.array_position(x["h"], g) - 1, g, x["n"]))))
    is_run = F.col("run") > 0
    reach = F.greatest(F.col("p") - F.col("longest"), F.lit(0))
    near = (rows.select(*row, "m", "h", "longest", F.explode(F.concat(whole, short)).alias("x"))
            .select(*row, "m", "h", "longest", "x.p", "x.g", "x.run")
            .select(*row, "m", "p", "g", "run", F.when(is_run, F.col("p")).otherwise(reach).alias("off"),
                    F.when(is_run, F.array("g")).otherwise(
                        F.slice("h", reach + 1, 2 * F.col("longest"))).alias("around")))
    # windows of the item's words (all words of a shorter document)
    hits = near.join(grams, "g").where(~is_run | (F.col("run") == F.col("n")))
    start = F.greatest(F.least(F.col("p") - F.col("q"), F.col("m") - F.col("n")), F.lit(0))
    hits = hits.withColumn("start", F.when(is_run, F.col("p")).otherwise(start)).where(F.col("start") >= F.col("off"))
    size = F.greatest(F.col("n") - SHINGLE + 1, F.lit(1))
    windows = hits.groupBy(*row, "n", "start").agg(
        F.first(F.slice("around", F.col("start") - F.col("off") + 1, size)).alias("wh")).withColumn(
        "fp", simhash(F.col("wh")))
    # multi-index blocks: an item stores the near values of each block, a window its own value
    blocks = [F.struct(F.lit(k).alias("k"), _block(F.col("ifp"), k).alias("v")) for k in range(BLOCKS)]
    values = items.select("item_id", "n", "ih", "ifp", F.explode(F.array(*blocks)).alias("b")).select(
        "item_id", "n", "ih", "ifp", F.col("b.k").alias("k"), F.explode(F.transform(
            F.array(*[F.lit(x).cast("long") for x in _near_values()]), lambda x: x.bitwiseXOR(F.col("b.v")))).alias("v"))
    probes = windows.withColumn("b", F.explode(F.array(
        *[F.struct(F.lit(k).alias("k"), _block(F.col("fp"), k).alias("v")) for k in range(BLOCKS)]))).select(
        *row, "n", "start", "wh", "fp", F.col("b.k").alias("k"), F.col("b.v").alias("v"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))
    found = probes.join(values, ["n", "k", "v"]).withColumn("distance", distance).where(F.col("distance") <= RADIUS) \
        .withColumn("similarity", similarity(F.col("wh"), F.col("ih"))).where(F.col("similarity") >= SIMILARITY)
    best = F.max_by(F.struct("similarity", "distance", "start"),
                    F.struct(F.col("similarity"), -F.col("start"), -F.col("distance")))
    return found.groupBy(*key, "item_id").agg(best.alias("x")).select(
        *key, "item_id", "x.similarity", F.col("x.distance").cast("int").alias("distance"),
        F.col("x.start").cast("int").alias("start"))
