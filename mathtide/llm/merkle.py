"""Merkle manifest of a dataset.

Every row is a leaf: the SHA-256 of its fields.  Per group (source) the leaves,
in the order of their key, are the bottom of a tree of fanout 3: while a group
has several nodes, every ``fanout`` consecutive ones become the hash of their
digests; the last run may be shorter, even one node.  What remains is the group's
subroot.  The subroots, ordered by group, are the leaves of one more such tree,
whose top is the root.

Method: slot pivot.  One aggregate per level over (group, parent) spreads the
children's digests into ``fanout`` columns by conditional aggregates; the hash of
the concatenated columns is the parent, and the concatenation without a child's
own column is that child's siblings.  Rows are dealt once by (group, block of
fanout ** TIER leaves), and all levels inside a block are aggregates over keys
that contain that pair, so no level exchanges rows.  The blocks' tops are the
leaves of the next tier, with fanout ** TIER times fewer rows, and a node's path
is its path in the block followed by the block's own path, joined on the pair.
A group with most of all rows is many blocks; only its rank needs care, and that
is the skew-safe one of the library.

Defined results: a null field counts as ``-``; null keys come first and are
carried; null and repeated keys and repeated rows are leaves of their own, ordered
by key, then digest, so the manifest does not depend on how the table is stored.
A group of one row has its leaf as subroot, one group's subroot is the root.  An
empty table gives no rows.  Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import keep
from mathtide.operators.ranking import global_rank

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
STEPS = "array<struct<before:string,after:string>>"
TIER = 5            # levels inside one block: at most FANOUT ** TIER leaves in a row of an aggregate


def field(c: Column) -> Column:
    """One field: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of a row's fields."""
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (array of struct before, after) give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(
        F.concat(step["before"], digest, step["after"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, lowest level first, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _tier(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Blocks of ``nodes`` (g, i, n, digest, payload) after up to ``levels``
    levels: g, i (of the block), n (blocks of the group), digest, and ``below``,
    an array of struct(payload, path) of the block's nodes."""
    state = nodes.select(
        "g", F.expr(f"i div {fanout ** levels}").alias("block"), "i", "n", "digest",
        F.array(F.struct("payload", F.array().cast(STEPS).alias("path"))).alias("below"))
    state = state.repartition("g", "block")
    slots = range(fanout)
    for _ in range(levels):
        slot = F.col("i") % fanout
        # the pivot: one column of digests, and one of what lies below, for each slot
        state = state.groupBy("g", "block", F.expr(f"i div {fanout}").alias("i"), "n").agg(
            *[F.max(F.when(slot == k, F.col("digest"))).alias(f"c{k}") for k in slots],
            *[F.first(F.when(slot == k, F.col("below")), ignorenulls=True).alias(f"b{k}") for k in slots])
        digests = [F.coalesce(f"c{k}", F.lit("")) for k in slots]

        def climbed(k):
            own = F.struct(F.concat(F.lit(""), *digests[:k]).alias("before"),
                           F.concat(F.lit(""), *digests[k + 1:]).alias("after"))
            return F.transform(f"b{k}", lambda x: F.struct(
                x["payload"].alias("payload"), F.array_append(x["path"], own).alias("path")))
        empty = F.array().cast(state.schema["b0"].dataType)
        top = F.col("n") == 1           # a group of one node is done and stays as it is
        state = state.select(
            "g", "block", "i", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
            F.when(top, F.col("c0")).otherwise(F.sha2(F.concat(*digests).cast("binary"), 256)).alias("digest"),
            F.when(top, F.col("b0")).otherwise(
                F.concat(*[F.coalesce(climbed(k), empty) for k in slots])).alias("below"))
    return state.select("g", F.col("block").alias("i"), "n", "digest", "below")


def _climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The tiers over ``nodes``, lowest first; the last has one row per group.
    Each is a table of its own: it is read on the way up and on the way down."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = [keep(_tier(nodes, fanout, levels), "merkle-tier")]
    while most > fanout ** levels:
        most = -(-most // fanout ** levels)
        tiers.append(keep(_tier(tiers[-1].select("g", "i", "n", "digest", F.col("i").alias("payload")),
                                fanout, levels), "merkle-tier"))
    return tiers


def _descend(tiers: list[DataFrame], rest: DataFrame) -> DataFrame:
    """payload and path of every node below ``tiers``: its path in its block, then
    the path ``rest`` of the block (g, i, rest; other columns are carried)."""
    carried = [c for c in rest.columns if c not in ("g", "i", "rest")]
    for tier in reversed(tiers):
        found = tier.select("g", "i", "below").join(rest, ["g", "i"]).select(
            "g", "rest", *carried, F.explode("below").alias("x"))
        rest = found.select("g", F.col("x.payload").alias("i"), F.concat("x.path", "rest").alias("rest"), *carried)
    return rest.withColumnsRenamed({"i": "payload", "rest": "path"})


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id",
             fanout: int = FANOUT, levels: int = TIER, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns of ``carry``, then key, group,
    leaf, path (array of struct before, after, leaf upwards), subroot and root.

    ``fold(leaf, path)`` equals root exactly if the row is unchanged."""
    carry = dict(carry or {})
    payload = F.struct(F.col(key).alias("key"), F.col(group).alias("group"), leaf_hash([F.col(f) for f in fields])
                       .alias("leaf"), *[c.alias(f"c{k}") for k, c in enumerate(carry.values())])
    # digests once, before the ranking reads them twice
    leaves = keep(docs.select(payload.alias("payload"), F.when(F.col(group).isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("v"), F.col(group).cast("string"))).alias("g")), "merkle-leaves")
    leaves = leaves.select("g", "payload", F.col("payload.key").alias("k"), F.col("payload.leaf").alias("digest"))
    ranked = global_rank(leaves, ["k", "digest"], "i", ["g"])
    sizes = leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    nodes = keep(ranked.join(sizes, "g").select("g", "i", "n", "digest", "payload"), "merkle-nodes")
    tiers = _climb(nodes, fanout, levels)

    # the tree of subroots; "n" sorts before every "v...", and strings sort by their UTF-8 bytes
    subroots = tiers[-1].select("g", "digest")
    ordered = keep(global_rank(subroots, ["g"], "i"), "merkle-groups")
    upper = _climb(ordered.select(F.lit("root").alias("g"), "i", F.lit(ordered.count()).cast("long").alias("n"),
                                  "digest", F.struct("g", "digest").alias("payload")), fanout, levels)
    root = upper[-1].select("g", "i", F.array().cast(STEPS).alias("rest"), F.col("digest").alias("root"))
    tops = _descend(upper, root).select(F.col("payload.g").alias("g"), F.lit(0).cast("long").alias("i"),
                                        F.col("path").alias("rest"), F.col("payload.digest").alias("subroot"), "root")
    return _descend(tiers, tops).select(
        *[F.col(f"payload.c{k}").alias(name) for k, name in enumerate(carry)],
        F.col("payload.key").alias(key), F.col("payload.group").alias(group), F.col("payload.leaf").alias("leaf"),
        "path", "subroot", "root")


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every
    document, where the documents whose id's crc32 is even have lost their line
    feeds when they are checked (a null id is the empty text, crc32 0)."""
    text = F.col("text")
    lost = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    seen = F.when(lost, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    fields = [seen if f == "text" else F.col(f) for f in FIELDS]
    listed = manifest(docs, carry={"checked": leaf_hash(fields)})
    folded = fold(F.col("checked"), F.col("path"))
    return listed.select("doc_id", "leaf", "subroot", "root",
                         F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
                         folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
