"""Packing documents into sequences of a fixed number of tokens.

Pieces are items of 1 to ``capacity`` tokens, so their whole multiset is a
histogram of at most ``capacity`` counts, and the plan is made on the driver
from that histogram alone, for any number of documents:

1. Martello-Toth dominance reduction, largest items first: a set of two or three
   items that provably dominates every other way to fill the largest item's
   sequence is fixed for good, as often as its items last.
2. Best-fit decreasing for what remains, many equal sequences at a time.

The plan is a list of patterns (how many sequences, which sizes).  A piece finds
its place from its size and its rank among the pieces of that size; ranks come
from counts by (size, salt) and a window within each (size, salt), with as many salts
as a size's pieces need.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.arrow_map import map_batches
from quarry.llm.ranges import literals
from quarry.llm.storage import materialize, small, text_or_empty
from quarry.llm.tokens import pieces_for, with_end

#: Pieces of one size that a window ranks, about: sizes with more are dealt to several.
RANKED_ROWS = 20_000


@dataclass
class Pattern:
    """``bins`` equal sequences, each with ``count`` items of ``size`` for (size, count) in ``items``."""

    bins: int
    items: list[tuple[int, int]] = field(default_factory=list)


class Stock:
    """Counts by size, with the sizes that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.remove(size)

    def put(self, size: int, n: int) -> None:
        if size not in self.count:
            bisect.insort(self.sizes, size)
        self.count[size] = self.count.get(size, 0) + n

    def largest(self, room: int) -> int | None:
        at = bisect.bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else None

    def smallest(self, n: int) -> int:
        """Total of the ``n`` smallest items, more than any room if there are fewer."""
        total = 0
        for s in self.sizes:
            got = min(n, self.count[s])
            total, n = total + got * s, n - got
            if not n:
                return total
        return 1 << 60

    def fullest(self, room: int) -> int:
        """The largest total of any items that fit ``room``."""
        reach, mask = 1, (1 << (room + 1)) - 1
        for s in self.sizes[: bisect.bisect_right(self.sizes, room)]:
            for _ in range(min(self.count[s], room // s)):
                wider = reach | (reach << s) & mask
                if wider == reach:
                    break
                reach = wider
            if reach >> room & 1:
                return room
        return reach.bit_length() - 1


def dominating(stock: Stock, room: int) -> tuple[int, ...] | None:
    """Items of ``stock`` that with the current one dominate all other ways to use its ``room``.

    A set dominates another if the other's items can be dealt to its items
    without exceeding them.  One item does so if no total that fits is larger.
    Two items a >= b do so, where three never fit, if a is the largest that fits
    and each pair that fits has its smaller item within b or its total within a.
    """
    if (a := stock.largest(room)) is None:
        return ()
    if a == room or stock.smallest(2) > room or stock.fullest(room) == a:
        return (a,)
    if stock.smallest(3) <= room:
        return None
    left = dict(stock.count)
    left[a] -= 1
    b = max((s for s in stock.sizes if s <= room - a and left[s]), default=0)
    for d in stock.sizes[bisect.bisect_right(stock.sizes, b) : bisect.bisect_right(stock.sizes, room // 2)]:
        c = stock.largest(room - d)
        if c > d or stock.count[d] > 1:
            if c + d > a:
                return None
    return (a, b) if b else (a,)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns fixed by dominance, and the counts of the items that are left.

    An item that nothing dominates stays in the instance, as a partner and as an
    alternative for the smaller ones.
    """
    stock, fixed = Stock(counts), []
    for size in sorted(counts, reverse=True):
        while size in stock.count:
            stock.take(size, 1)
            others = dominating(stock, capacity - size)
            stock.put(size, 1)
            if others is None:
                break
            items: dict[int, int] = {size: 1}
            for o in others:
                items[o] = items.get(o, 0) + 1
            times = min(stock.count[s] // k for s, k in items.items())
            for s, k in items.items():
                stock.take(s, times * k)
            fixed.append(Pattern(times, sorted(items.items(), reverse=True)))
    return fixed, dict(stock.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing: each item goes to the fullest sequence that has room for it."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern) -> None:
        if pattern.bins:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append(pattern)

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = min(capacity // size, n)
                bins = n // each
                put(capacity - each * size, Pattern(bins, [(size, each)]))
                n -= bins * each
                continue
            room = rooms[at]
            pattern = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = min(room // size, n)
            bins = min(pattern.bins, n // each)
            put(room - each * size, Pattern(bins, [*pattern.items, (size, each)]))
            put(room, Pattern(pattern.bins - bins, pattern.items))
            n -= bins * each
    return [p for ps in by_room.values() for p in ps]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (size, first rank, first sequence, items per sequence, first offset), sorted.

    There are at most a few patterns for each size and 45 sizes in a pattern, so
    the table stays within a few MB whatever the number of documents.
    """
    rows, sequence, rank = [], 0, {}
    for p in patterns:
        offset = 0
        for size, each in p.items:
            rows.append((size, rank.get(size, 0), sequence, each, offset))
            rank[size] = rank.get(size, 0) + p.bins * each
            offset += size * each
        sequence += p.bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def cut_all(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces: of ``capacity`` each but perhaps a document's first."""
    n = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    ahead = (n * capacity - lengths)[doc]  # by so much the first piece is shorter
    start = np.maximum(piece * capacity - ahead, 0)
    return doc, piece, start, np.where(piece == 0, capacity - ahead, capacity)


def tokenised_pieces(
    docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool, special_tokens: bool
) -> DataFrame:
    """Pieces of all documents: (doc_id, piece, start, length, ids_crc32[, ids])."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def task():
        encoder = pieces_for(sent.value, special_tokens)

        def work(batch: pa.RecordBatch) -> dict:
            tokens, starts = with_end(*encoder.encode_column(batch.column(1)), end_id)
            doc, piece, start, length = cut_all(np.diff(starts), capacity)
            at = starts[doc] + start
            data = memoryview(tokens.view(np.uint8))
            parts = [(4 * a, 4 * b) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            out = {
                "doc_id": batch.column(0).take(pa.array(doc)),
                "piece": piece,
                "start": start,
                "length": length,
                "ids_crc32": [zlib.crc32(data[a:b]) for a, b in parts],
            }
            if with_ids:
                out["ids"] = [tokens[a // 4 : b // 4].astype(np.int32) for a, b in parts]
            return out

        return work

    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_batches(docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)), schema, task, 4 << 20, holds=True)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = 1024,
    end_id: int = 2,
    with_ids: bool = False,
    special_tokens: bool = False,
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    ``tokenizer`` is the content of a tokenizers JSON file.  Every document ends
    with ``end_id``, so null and empty texts are one token.  A document of more
    than ``capacity`` tokens is cut into pieces of ``capacity``, the first one
    shorter where it doesn't come out even.  Within a sequence the offsets have
    no gaps.  Sequences are numbered from 0.  Repeated rows are documents of
    their own; rows of one id and piece are ranked in any order.  Very long texts
    are encoded whole.  Other columns, whatever their names, are not read.  With ``special_tokens`` the string of a special token in a text is
    that token, otherwise ordinary text.  An empty table gives no rows.
    """
    pieces = materialize(tokenised_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids, special_tokens), "pieces")
    totals = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # one row for each size
    table = places(plan(totals, capacity))
    salts = literals([1 + totals.get(size, 0) // RANKED_ROWS for size in range(capacity + 1)])
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(salts, "length")))
    by_salt = materialize(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "counts")
    n_salts = sum(1 + n // RANKED_ROWS for n in totals.values())
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn("nth", nth).join(small(first, n_salts), ["length", "salt"])
    columns = [c for c in pieces.columns if c != "salt"]
    ranked = ranked.select(*columns, (F.col("first") + F.col("nth") - 1).alias("rank"))
    keys = table[:, 0] << 48 | table[:, 1]

    def task():
        def work(batch: pa.RecordBatch) -> dict:
            size = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, size << 48 | rank, "right") - 1
            _, first_rank, sequence, each, offset = table[at].T
            nth = rank - first_rank
            placed = {"sequence_id": sequence + nth // each, "offset": offset + nth % each * size}
            return {c: batch.column(c) for c in columns} | placed

        return work

    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns)
    out = map_batches(ranked, f"{kinds}, sequence_id long, offset long", task)
    ids = ["ids"] * with_ids
    return out.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *ids
    )


def packed_sequences(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, ``capacity`` ids at most each.

    Rows, nulls and repeats count as in pack(); an empty table gives no sequences.
    """
    placed = pack(docs, tokenizer, with_ids=True, **options)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
