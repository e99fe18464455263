"""Packing token pieces into sequences: dominance reduction, then best fit.

Only the histogram of piece lengths, at most `capacity` rows whatever the input, reaches the driver. The reduction fixes
sets of one to three lengths that provably dominate every other set with the same largest piece (Martello and Toth), in
bulk; what is left is packed best fit, largest first, also in bulk. The outcome is a short list of slots, at most a few
for each length, and each piece finds its slot by its rank among the pieces of its length. Ranks come from counts of
(length, bucket), a bucket being a hash of the row's number, so no length and no row, however common, meets in one task.

Defined results: null text is empty (one piece, of the end id alone); rows that repeat a doc_id are packed as rows of
their own; a null doc_id stays null; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import CACHED, LONG, byte_chars, split_pattern
from .common import cut, lean

#: Rows that share a bucket of one length, about.
BUCKET = 50_000


class Tokens(dict):
    """Pre-token -> ids as little-endian unsigned 32-bit integers, for a byte-level vocabulary of the tokenizers library."""

    def __init__(self, config: str, pattern: str):
        import tiktoken

        super().__init__()
        spec = json.loads(config)
        back = {c: b for b, c in enumerate(byte_chars())}
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the merges of this vocabulary are not in the order of its ids")
        ranks = {bytes(back[c] for c in t): i for t, i in vocabulary.items()}
        self.single = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = split_pattern(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.single(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONG:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        for special, ids in self.added.items():  # their strings stand for themselves wherever they occur
            if special in text:
                return ids.join(self.encode(part) for part in text.split(special))
        return b"".join(map(self.__getitem__, self.split(text)))


@functools.lru_cache(1)
def tokens(config: str, pattern: str) -> Tokens:
    return Tokens(config, pattern)


def pieces(docs: DataFrame, vocabulary_path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id; longer ones than capacity are cut so that
    all pieces but the first are full."""
    with open(vocabulary_path, encoding="utf-8") as file:
        config = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(config.value, pattern)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = own.encode(text.as_py() or "") + end
                total = len(ids) // 4
                first = total % capacity or capacity
                for number, to in enumerate(range(first, total + 1, capacity)):
                    at = max(0, to - capacity) if number else 0
                    rows.append(row)
                    piece.append(number)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
        own.clear()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Lengths on hand, with counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, items: tuple[int, ...], times: int) -> None:
        for s in items:
            self.n[s] -= times
        gone = {s for s in items if not self.n[s]}
        for s in gone:
            del self.n[s]
        if gone:
            self.sizes = [s for s in self.sizes if s not in gone]

    def smallest(self, many: int, without: int) -> list[int]:
        """The smallest pieces, beside one piece of length `without`."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(many - len(out), self.n[s] - (s == without))
            if len(out) == many:
                break
        return out

    def largest_within(self, room: int, without: tuple[int, ...]) -> int | None:
        at = int(np.searchsorted(self.sizes, room, "right")) - 1
        while at >= 0:
            s = self.sizes[at]
            if self.n[s] > without.count(s):
                return s
            at -= 1
        return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that can be fixed without loss of optimality, each with the times it is used, and the counts left over."""
    stock, fixed, at = _Stock(counts), [], None
    while stock.sizes:
        below = [s for s in stock.sizes if at is None or s < at]
        if not below:
            break
        j = below[-1]
        found = _dominating(stock, j, capacity)
        if found is None:
            at = j  # nothing dominates for this length: go on to the next smaller one
            continue
        need = {s: found.count(s) for s in found}
        times = min(stock.n[s] // k for s, k in need.items())
        if len(found) == 3 or len(found) == 2 and sum(found) != capacity:
            times = max(1, times - 3)  # the conditions look at a few pieces beyond the set: stop before they change
        stock.take(tuple(need), 0)
        for s, k in need.items():
            stock.take((s,), k * times)
        fixed.append((found, times))
    return fixed, stock.n


def _dominating(stock: _Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    room = capacity - j
    small = stock.smallest(3, j)
    if not small or small[0] > room:
        return (j,)
    k = stock.largest_within(room, (j,))
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return (j, k)  # it fills the sequence, or only one more piece fits and this is the largest
    if len(small) == 3 and sum(small) <= room:
        return None  # three more fit: no set this small is known to dominate
    best = None
    for a in reversed(stock.sizes):
        if a <= room and stock.n[a] > (a == j):
            b = stock.largest_within(min(room - a, a), (j, a))
            if b is not None and (best is None or a + b > sum(best)):
                best = (a, b)
    if best is None or k >= sum(best):
        return (j, k)
    a, b = best
    if k == a:
        between = []
        for s in (s for s in stock.sizes if b <= s <= a):
            spare = stock.n[s] - (s == j) - (s == a) - (s == b)
            between += [s] * min(2 - len(between), max(0, spare))
        if len(between) < 2 or sum(between) > room:
            return (j, a, b)
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, over whole counts of equal lengths: sequences that hold the same lengths stay together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            rooms = [r for r in bins if r >= s]
            room = min(rooms) if rooms else capacity
            content, many = bins[room].pop() if rooms else ((), -(-left // (capacity // s)))
            if rooms and not bins[room]:
                del bins[room]
            each = room // s
            full, rest = divmod(left, each)
            full = min(full, many)
            left -= full * each
            if full:
                bins.setdefault(room - each * s, []).append((content + (s,) * each, full))
            if left and full < many:
                bins.setdefault(room - left * s, []).append((content + (s,) * left, 1))
                full, left = full + 1, 0
            if rooms and full < many:
                bins.setdefault(room, []).append((content, many - full))
    return [x for group in bins.values() for x in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequence contents and the times each is used."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces of this length in each sequence), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in sequences:
        offset = 0
        for s in dict.fromkeys(content):
            k = content.count(s)
            rows.append((s, used.get(s, 0), sequence, offset, k))
            used[s] = used.get(s, 0) + k * times
            offset += k * s
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, by the row's number, so that rows that repeat are dealt like others."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))


def packed(docs: DataFrame, vocabulary_path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of docs with sequence_id and offset, in as few sequences as the plan finds."""
    rows = cut(pieces(docs, vocabulary_path, pattern, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan(counts, capacity))
    buckets = max(1, -(-sum(counts.values()) // BUCKET))
    rows = _dealt(rows, buckets)
    sums = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    ranked = rows.withColumn("inside", inside).join(sums, ["length", "bucket"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("before") + F.col("inside") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            slot = table[np.searchsorted(base, length << 44 | rank, "right") - 1]
            in_slot = rank - slot[:, 1]
            sequence = slot[:, 2] + in_slot // slot[:, 4]
            offset = slot[:, 3] + in_slot % slot[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
