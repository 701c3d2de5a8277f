"""Packing documents into training sequences.

A document is its token ids and one end id.  Whole sequences are cut from its
front, so that one tail of fewer than ``LENGTH`` ids is left; the tails are packed
into sequences (bins) by first-fit decreasing, longest tail first, each into the
first bin with room for it.  The bins' free space is kept in a tournament tree:
a leaf is a bin's free space, an inner node the larger of its two children, so the
first bin with enough room is found in log2(bins) steps from the root.  This
runs independently in randomised groups of documents (about ``GROUP`` each, dealt
by a hash of the row's place in the stored table), so that a group is a bounded
task at any size of the input; every group packs all its tails.

First-fit decreasing leaves a few percent of a group's bins' space open.  Tails may
be cut, so with ``top_up`` the emptiest bins are dissolved and their tails poured
into the gaps of the others, cut where a gap is full; one bin a group may stay
partly filled.  Sequences are padded to ``LENGTH``, except where the fill is a power of
two: such a sequence counts as full.

Tokens: the byte-pair vocabulary of ``path`` (a parameter) as the ``tokenizers``
library reads it, without added special tokens (``operators.bpe``).

One pass tokenises, and one row per document (crc32 of its whole sequences, ids of
its tail) is shuffled, once, by group.  Defined results: a null or empty text is the
end id alone; null and repeated doc_ids are carried; repeated rows are documents
of their own; a very long text is many whole sequences and one tail; an empty table
gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.llm.common import stored, text_or_empty
from mathtide.operators.bpe import PIECE, Vocabulary

LENGTH = 1024
GROUP = 4096         # documents of a group, on average
END = 0


class Tournament:
    """Free space of bins 0, 1, ...: the first bin with at least a given room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin that has room for it; its number."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; an item is never larger than ``capacity``.  Equal
    sizes go in the order given."""
    tree = Tournament(len(sizes), capacity)
    bins: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = tree.place(sizes[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
    return bins


def full(fill: int, capacity: int) -> bool:
    """Needs no padding: at capacity, or at a power of two."""
    return fill == capacity or fill & (fill - 1) == 0


def pour(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length): the emptiest bins are dissolved into the
    gaps of the others, items cut where a gap is full."""
    out = [[(k, 0, sizes[k]) for k in b] for b in bins]
    fills = [sum(sizes[k] for k in b) for b in bins]
    order = sorted((b for b in range(len(bins)) if not full(fills[b], capacity)), key=lambda b: (-fills[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        to, source = order[low], order[high]
        room = capacity - fills[to]
        if room == 0:
            low += 1
            continue
        item, start, length = out[source].pop()
        part = min(room, length)
        out[to].append((item, start, part))
        fills[to] += part
        fills[source] -= part
        if part < length:
            out[source].append((item, start + part, length - part))
        if not out[source]:
            high -= 1
    return [b for b in out if b]


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int) -> Iterator[pa.RecordBatch]:
    """Per document the crc32 of its whole sequences and the ids of its tail."""
    vocabulary = Vocabulary(path)
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            piece = b.slice(at, PIECE)
            counts, crcs, tails = [], [], []
            for text in piece.column("text"):
                ids = np.array([*vocabulary.ids(text.as_py()), end], dtype="<u4")
                whole = len(ids) // length * length
                counts.append(len(ids))
                crcs.append([zlib.crc32(ids[k:k + length]) for k in range(0, whole, length)])
                tails.append(ids[whole:].tobytes())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("g"), piece.column("place"), pa.array(counts, pa.int64()),
                 pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                ["doc_id", "g", "place", "n", "crcs", "tail"])


def _pack(docs: pa.Table, length: int, top_up: bool) -> dict[str, list | np.ndarray]:
    """The pieces of one group's documents: number of the document, start,
    length, crc32, ids (of tails), number of the sequence, offset."""
    numbers = docs.column("n").to_numpy()
    tails = docs.column("tail").to_pylist()
    sizes = [len(t) // 4 for t in tails]
    held = [k for k, s in enumerate(sizes) if s]
    own = [sizes[k] for k in held]
    bins = first_fit_decreasing(own, length)
    packed = pour(bins, own, length) if top_up else [[(k, 0, own[k]) for k in b] for b in bins]
    rows = []
    for sequence, members in enumerate(packed):
        offset = 0
        for item, start, size in members:
            k = held[item]
            ids = tails[k][4 * start:4 * (start + size)]
            rows.append((k, numbers[k] - sizes[k] + start, size, zlib.crc32(ids), ids, sequence, offset))
            offset += size
    sequence = len(packed)
    for k, crcs in enumerate(docs.column("crcs").to_pylist()):
        for j, crc in enumerate(crcs):
            rows.append((k, j * length, length, crc, None, sequence, 0))
            sequence += 1
    names = ["k", "start", "length", "ids_crc32", "ids", "sequence", "offset"]
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def pack(docs: DataFrame, path: str, length: int = LENGTH, group: int = GROUP, end: int = END,
         top_up: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, place (a number of the document), ids (little-endian
    unsigned 32-bit, of packed tails; whole sequences are cut again from the text).

    ``sequence_id`` is the group's number times 2**32 plus a number in the group."""
    rows = stored(docs).select("doc_id", text_or_empty().alias("text"),
                               F.xxhash64("__file", "__pos").alias("place"), "__file", "__pos")
    groups = max(1, round(docs.count() / group))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    dealt = rows.select("doc_id", "text", "place", F.pmod(F.xxhash64("__pos", "__file", F.lit("pack")), F.lit(groups))
                        .alias("g"))
    tokenised = dealt.mapInArrow(lambda batches: _tokenise(batches, path, length, end),
                                 f"doc_id {id_type}, g long, place long, n long, crcs array<long>, tail binary")

    def packed(table: pa.Table) -> pa.Table:
        # the order of arrival must not decide
        table = table.take(pc.sort_indices(table, sort_keys=[("place", "ascending"), ("tail", "ascending")]))
        g = table.column("g")[0].as_py()
        found = _pack(table, length, top_up)
        k = pa.array(found["k"], pa.int64())
        return pa.table({
            "doc_id": table.column("doc_id").take(k),
            "start": pa.array(found["start"], pa.int64()), "length": pa.array(found["length"], pa.int64()),
            "ids_crc32": pa.array(found["ids_crc32"], pa.int64()),
            "doc_tokens": table.column("n").take(k),
            "sequence_id": pa.array([(g << 32) + s for s in found["sequence"]], pa.int64()),
            "offset": pa.array(found["offset"], pa.int64()),
            "place": table.column("place").take(k), "ids": pa.array(found["ids"], pa.binary())})

    return tokenised.groupBy("g").applyInArrow(
        packed, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                "offset long, place long, ids binary")
