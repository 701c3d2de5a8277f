"""Repairing the structure of conversations.

A conversation is its turns in order.  It should read ``(s?(ua)+)?`` by the initials
of its roles: an optional system turn, then user and assistant in turns.  Edits:
Keep (K) costs 0, Rerole to user or assistant (R) 1, Delete (D) 2, Insert of an
empty user or assistant turn (I) 5.  A blank turn and a repeat of an earlier one
must be deleted; an undeleted truncated turn adds 5.  The cheapest repair is
chosen, ties by the least string of initials (ASCII), its audit.

Method: weighted CYK interval parsing.  The grammar is in Chomsky normal form with
a nonterminal for "these turns take the pattern from place p to place q":
X[p,q] -> X[p,r] X[r,q], and X[p,q] -> turn by each edit that does so, closed under
insertions on both sides.  A cell holds the least (cost, audit) of a span and nonterminal.
Spans are combined bottom-up by length: 1, 2, 4, ... turns.  One split per span is
enough, as a derivation of X[p,q] can be cut at any turn, at the place r
that the pattern has reached there.  The least (cost, audit) of a span needs only
the least of its parts: a place takes as many letters other than I as it has turns, so of two audits of
the same cost neither begins with the other, and what follows cannot change
their order.

Conversations have no bound, so a task never holds one: turns are numbered by the
skew-safe rank, cells of ``BLOCK`` consecutive turns are one row, and spans are
combined ``FAN`` at a time, level by level, as Spark aggregates (an audit is one
value, so Spark's 2 GB for a value bound a conversation).  The hash of a
repaired conversation is a chain over its text and is computed as a stream in
sorted order, in bounded memory.

Defined results: null ids, turns, roles and texts are read as one space; a null conv_id is a
conversation of its own; null turns come first, turns with the same number are ordered by the digest of role and text;
repeated rows are turns of their own (and repeats, if they are equal); an empty table gives no
rows; a conversation without turns has cost 0, an empty audit and the empty text.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import BLANKS, keep
from mathtide.operators.ranking import global_rank

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK = 128
FAN = 16                        # spans combined into one at every level above the blocks
PIECE = 1000                    # blocks repaired at a time
START, SYSTEM, USER, ASSISTANT = range(4)       # places in the pattern: what came last
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
PAIRS = [(p, q) for p in range(4) for q in range(4) if q >= p or (p, q) == (ASSISTANT, USER)]
INDEX = {pair: k for k, pair in enumerate(PAIRS)}
RULES = [(k, INDEX[p, r], INDEX[r, q]) for k, (p, q) in enumerate(PAIRS) for r in range(4)
         if (p, r) in INDEX and (r, q) in INDEX]
LEGAL = ("su", "ua", "au")
# a turn is one letter: its role's initial s, u, a or x (any other); upper case if it
# is truncated, 1 to 4 if it must be deleted
MUST_GO = dict(zip("1234", "suax"))

Cells = tuple      # per pair of places the least (cost, audit), or None


def join(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans together."""
    out = [None] * len(PAIRS)
    for k, i, j in RULES:
        a, b = left[i], right[j]
        if a is not None and b is not None:
            found = (a[0] + b[0], a[1] + b[1])
            if out[k] is None or found < out[k]:
                out[k] = found
    return tuple(out)


def _insertions() -> Cells:
    """Cells of an empty span: the closure of inserting users and assistants."""
    best = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, q), (cost, audit) in list(best.items()):
            for (at, letter), to in NEXT.items():
                if at == q and letter in "ua":
                    found = (cost + INSERT, audit + "I")
                    best[p, to] = min(best.get((p, to), found), found)
    return tuple(best.get(pair) for pair in PAIRS)


NO_TURN = _insertions()


@lru_cache(maxsize=None)        # one entry per letter
def turn_cells(letter: str) -> Cells:
    """Cells of one turn, closed under insertions on both sides."""
    out = [None] * len(PAIRS)

    def offer(p, q, cost, audit):
        k = INDEX[p, q]
        if out[k] is None or (cost, audit) < out[k]:
            out[k] = (cost, audit)
    for p in range(4):
        offer(p, p, DELETE, "D")
    if letter not in MUST_GO:
        extra = TRUNCATED if letter.isupper() else 0
        for (p, initial), q in NEXT.items():
            if initial == letter.lower():
                offer(p, q, KEEP + extra, "K")
            if initial in "ua":
                offer(p, q, REROLE + extra, "R")
    return join(join(NO_TURN, tuple(out)), NO_TURN)


def combine(spans: list[Cells]) -> Cells:
    """Cells of consecutive spans together, bottom-up by length."""
    while len(spans) > 1:
        spans = [join(spans[k], spans[k + 1]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0] if spans else NO_TURN


@lru_cache(maxsize=1 << 14)
def span_cells(letters: str) -> Cells:
    return combine([turn_cells(x) for x in letters])


def best_repair(cells: Cells) -> tuple[int, str]:
    """Least (cost, audit) from the start to where the pattern may end."""
    return min(c for c in (cells[INDEX[START, START]], cells[INDEX[START, ASSISTANT]]) if c is not None)


def illegal_pairs(letters: str) -> int:
    initials = [MUST_GO.get(x, x.lower()) for x in letters]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


SPAN = "first string, last string, illegal long, costs array<long>, audits array<string>"


def _span_batch(found: list[tuple[str, str, int, Cells]], keys: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*keys.values(), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()),
         pa.array([f[2] for f in found], pa.int64()),
         pa.array([[c[0] if c else None for c in f[3]] for f in found], pa.list_(pa.int64())),
         pa.array([[c[1] if c else None for c in f[3]] for f in found], pa.list_(pa.string()))],
        [*keys, "first", "last", "illegal", "costs", "audits"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of blocks of turns (g, b, letters)."""
    for whole in batches:
        for at in range(0, whole.num_rows, PIECE):
            batch = whole.slice(at, PIECE)
            found = [(x[0], x[-1], illegal_pairs(x), span_cells(x)) for x in batch.column("letters").to_pylist()]
            yield _span_batch(found, {"g": batch.column("g"), "b": batch.column("b")})


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of consecutive spans (g, b, parts in order)."""
    for whole in batches:
        for at in range(whole.num_rows):
            batch = whole.slice(at, 1)
            parts = batch.column("parts")[0].as_py()
            cells = combine([tuple((c, a) if a is not None else None for c, a in zip(p["costs"], p["audits"]))
                             for p in parts])
            between = sum(illegal_pairs(a["last"] + b["first"]) for a, b in zip(parts, parts[1:]))
            found = (parts[0]["first"], parts[-1]["last"], sum(p["illegal"] for p in parts) + between, cells)
            yield _span_batch([found], {"g": batch.column("g"), "b": batch.column("b")})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = []
        for costs, audits in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist()):
            best.append(best_repair(tuple((c, a) if a is not None else None for c, a in zip(costs, audits))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("g"), batch.column("illegal"), pa.array([b[0] for b in best], pa.int64()),
             pa.array([b[1] for b in best], pa.string())], ["g", "illegal", "cost", "audit"])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every repaired conversation.  Rows come sorted: a conversation's
    audit first, then its turns; they may go on in the next batch."""
    g, audit, at, place, digest, lines = None, "", 0, START, None, 0

    def line(role: str, text: str):
        nonlocal lines
        digest.update((("\n" if lines else "") + role + ":" + text).encode())
        lines += 1

    def insertions():
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            place = ASSISTANT if place == USER else USER
            line("user" if place == USER else "assistant", "")
            at += 1

    for batch in batches:
        ids, hashes = [], []
        for conversation, first, role, text in zip(*(batch.column(c).to_pylist() for c in ("g", "audit", "role", "text"))):
            if first is not None:
                if digest is not None:
                    ids.append(g)
                    hashes.append(digest.hexdigest())
                g, audit, at, place, digest, lines = conversation, first, 0, START, hashlib.sha256(), 0
                insertions()
                continue
            edit = audit[at]
            at += 1
            if edit == "K" and place == START and role[:1] == "s":
                place = SYSTEM
                line(role, text)
            elif edit != "D":
                place = ASSISTANT if place == USER else USER
                line(role if edit == "K" else "user" if place == USER else "assistant", text)
            insertions()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(hashes, pa.string())], ["g", "hash"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([digest.hexdigest()])], ["g", "hash"])


def damage(turns: DataFrame) -> DataFrame:
    """Damaged ``turns``: by crc32 of 'conv_id:turn' modulo 20 a row is dropped
    (0; it stays with ``present`` false), emptied (1), loses its .!? (2), is repeated (3) or becomes a user's (4)."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                        kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def _cells(flagged: DataFrame, sizes: DataFrame, block: int, fan: int) -> DataFrame:
    """g, illegal, cost, audit of every conversation of ``flagged`` (g, rank,
    letter), whose numbers of turns are in ``sizes`` (g, n)."""
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "letter"))), lambda x: x["letter"])
    blocks = flagged.groupBy("g", F.expr(f"rank div {block}").alias("b")).agg(F.array_join(in_order, "").alias("letters"))
    spans = keep(blocks.mapInArrow(_blocks, f"g string, b long, {SPAN}").join(sizes, "g"), "spans")
    result = spans.where(F.col("n") <= block).drop("b", "n", "first", "last")
    long = spans.where(F.col("n") > block)
    most = -(-(sizes.agg(F.max("n")).first()[0] or 0) // block)        # spans of the longest conversation
    while most > 1:
        most = -(-most // fan)
        parts = F.sort_array(F.collect_list(F.struct("b", "first", "last", "illegal", "costs", "audits")))
        long = keep(long.groupBy("g", F.expr(f"b div {fan}").alias("b")).agg(parts.alias("parts"))
                    .mapInArrow(_levels, f"g string, b long, {SPAN}"), "spans")
        if most == 1:
            result = result.unionByName(long.drop("b", "first", "last"))
    return result.mapInArrow(_finish, "g string, illegal long, cost long, audit string")


def repair(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text; a row
    whose ``present`` is false only names its conversation): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), present.alias("present"),
        F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(
            F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("g"))
    rows = rows.withColumn("d", F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256))
    ended = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    # narrow facts, written once: texts come back only for the hash
    facts = keep(rows.select("g", "conv_id", "turn", "d", "present", (ended == "").alias("blank"),
                             (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("open"),
                             F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")).alias("initial")),
                 "turns")
    said = F.when(F.col("present"), F.col("turn"))
    names = keep(facts.groupBy("g").agg(
        F.first("conv_id").alias("conv_id"), F.count(F.when(F.col("present"), 1)).alias("n"),
        F.coalesce(F.max(said) - F.min(said) + 1 - F.countDistinct(said), F.lit(0)).cast("long").alias("gaps")), "names")

    here = facts.where("present").select("g", "turn", "d", "blank", "open", "initial")
    ranked = keep(global_rank(here, ["turn", "d"], "rank", ["g"]), "ranked")
    firsts = (ranked.groupBy("g", "d").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1").drop("copies"))
    blank = F.col("blank")
    again = F.coalesce(F.col("rank") > F.col("first_rank"), F.lit(False)) & ~blank
    cut = F.col("open") & ~blank & ~again
    flagged = keep(ranked.join(firsts, ["g", "d"], "left").select(
        "g", "rank", blank.alias("blank"), again.alias("duplicate"), cut.alias("truncated"),
        F.when(blank | again, F.translate("initial", "suax", "1234")).when(cut, F.upper("initial"))
        .otherwise(F.col("initial")).alias("letter")), "flagged")
    faults = ("blank", "duplicate", "truncated")
    counts = flagged.groupBy("g").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in faults])
    repaired = keep(_cells(flagged.select("g", "rank", "letter"), names.select("g", "n"), block, fan), "repaired")

    none = F.lit(None).cast("string")
    lines = rows.where("present").select("g", F.lit(1).alias("kind"), "turn", "d", none.alias("audit"), "role", "text")
    heads = repaired.select("g", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"),
                            none.alias("d"), "audit", none.alias("role"), none.alias("text"))
    order = ["g", "kind", F.col("turn").asc_nulls_first(), "d"]
    hashes = (heads.unionByName(lines).repartition("g").sortWithinPartitions(*order)
              .select("g", "audit", "role", "text").mapInArrow(_repaired, "g string, hash string"))
    out = names.join(counts, "g", "left").join(repaired, "g", "left").join(hashes, "g", "left")
    return out.select("conv_id", "gaps", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                           for c in (*faults, "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("hash", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
