"""Repeated passages by a depth-limited radix sort of all byte suffixes.

Suffixes are ordered only through `depth` bytes, by most-significant-digit passes that go from coarse digits to fine ones;
after each pass groups of one are dropped, and groups that are equal through `depth` bytes are the repeated windows.

1. Each window of `depth` bytes has an anchor, its k-gram of the smallest hash, so equal windows have equal anchors, and
   neighbouring windows mostly share one. The first digit is the anchor's hash: one row stands for all windows (a run) at
   an anchor, about one for 30 bytes. Anchors that occur once need no further pass.
2. The second digit is the run's hash. Of equal runs all but the earliest are repeated as a whole.
3. Where different runs share an anchor, the windows of the earliest of each kind are compared one by one.

Each task first settles what it holds itself, so an anchor or window, however common, reaches the next pass as a row or two
of each task. Digits are hashes: 64 bits of the anchor, and among equal anchors 48 of a run and 56 of a window.

A byte is removed if a `depth`-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the same
document. Strings are judged on the input, not on what is left.

Verdicts belong to a row's text, not to its doc_id: where a doc_id has several texts, each carries a hash of itself (copy; 0
for all others), and doc_ids give the order only.

Defined results: null or short text keeps all its bytes; a null doc_id counts as the smallest; of rows that repeat a doc_id
none is earlier than the other, but a string is repeated where another of them has it at a smaller start; an empty table
gives an empty result. Other columns are ignored. No text is cut: a long one is hashed in overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean, lookup, stored

DEPTH, GRAM = 100, 40
#: Bytes hashed at once, rows settled at once, text bytes of a partition of the passes.
SEGMENT, SETTLE, PART = 1 << 18, 1 << 18, 12 << 20
#: Ids with several texts that are broadcast at most, 9 bytes each.
BROADCAST = 1 << 20
NULL_ID = -(1 << 63)
#: Bits that the second and third digit give up; each is compared among equal 64-bit anchors only.
RUN_BITS, WINDOW_BITS = np.uint64(16), np.uint64(8)
PLACE = np.uint64((1 << 21) - 1)
BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers from 0 on, and their inverses, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + DEPTH)
        _powers[:] = [
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))
        ]
    return _powers[0], _powers[1]


def prefix(buffer: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buffer) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[buffer] * up[: len(buffer)])])


def hashes(pre: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hash of the bytes [start, start + length), wherever they stand."""
    _, down = powers(len(pre))
    return _mix((pre[start + length] - pre[start]) * down[start])


def runs_of(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of the texts that end at `ends` in buffer, by anchor: first start, number, anchor hash, run hash."""
    n = len(buffer)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if n < DEPTH:
        return none
    pre = prefix(buffer)
    _, down = powers(n + 1)
    grams = _mix((pre[GRAM:] - pre[:-GRAM]) * down[: n - GRAM + 1])
    least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, DEPTH - GRAM + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := width - span:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & PLACE).astype(np.int64)
    count = len(anchor)
    edge = np.zeros(count + 1, np.int64)  # windows that reach over the end of a text
    np.add.at(edge, np.clip(ends - DEPTH + 1, 0, count), 1)
    np.add.at(edge, np.clip(ends, 0, count), -1)
    inside = np.cumsum(edge[:-1]) == 0
    new = np.ones(count, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    last = np.ones(count, bool)
    last[:-1] = new[1:] | ~inside[1:]
    first, final = np.flatnonzero(new & inside), np.flatnonzero(last & inside)
    number = final - first + 1
    return first, number, grams[anchor[first]], hashes(pre, first, number + DEPTH - 1) >> RUN_BITS


def segments(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of up to SEGMENT bytes: the bytes, and for each text part in it its end, the text's place, its shift."""
    parts: list[bytes] = []
    info: list[tuple[int, int]] = []
    size = 0

    def out():
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        place, shift = (np.array(x) for x in zip(*info))
        return np.frombuffer(b"".join(parts), np.uint8), ends, place, shift - (ends - lengths)

    for place, text in enumerate(texts):
        if len(text) < DEPTH:
            continue
        step = SEGMENT - DEPTH
        for at in range(0, max(1, len(text) - DEPTH + 1), step):
            part = text[at : at + step + DEPTH - 1]
            if size + len(part) > SEGMENT and parts:
                yield out()
                parts, info, size = [], [], 0
            parts.append(part)
            info.append((place, at))
            size += len(part)
    if parts:
        yield out()


def pack(*columns: np.ndarray) -> bytes:
    """Equally long 64-bit columns as compressed bytes; columns of small differences shrink most."""
    raw = b"".join(np.diff(c.view(np.int64), prepend=np.int64(0)).tobytes() if i > 1 else c.tobytes() for i, c in enumerate(columns))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    decompress = zstandard.ZstdDecompressor().decompress
    sizes = [zstandard.frame_content_size(b) // (8 * columns) for b in blobs]
    whole = np.zeros((columns, sum(sizes)), np.int64)
    at = 0
    for blob, n in zip(blobs, sizes):
        whole[:, at : at + n] = np.frombuffer(decompress(blob), np.int64).reshape(columns, n)
        np.cumsum(whole[2:, at : at + n], axis=1, out=whole[2:, at : at + n])
        at += n
    return list(whole)


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _dealt(part: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[rows[0]]), pack(*(c[rows] for c in columns))) for rows in np.split(order, cuts) if len(rows)]


def _by_place(columns, ids: int, start: int):
    """The columns in the order of documents and places, in which they compress best."""
    order = np.lexsort((columns[start], columns[ids]))
    return tuple(c[order] for c in columns)


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    """For each row whether it equals the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def settle_runs(gram, run, ids, start, number, copy, mark, keep_groups: bool):
    """First and second digit. mark is 1 on a row that stands for runs of several kinds, which their own task settles.

    Returns (repeated ids, starts, numbers, copies), (to compare: grams, ids, starts, numbers, copies), (left over for the
    next task)."""
    order = np.lexsort((copy, start, ids, run, mark, gram))
    gram, run, ids, start, number, copy, mark = (c[order] for c in (gram, run, ids, start, number, copy, mark))
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
    new_run = new_gram | np.concatenate([[True], (run[1:] != run[:-1]) | (mark[1:] != mark[:-1])]) if len(gram) else new_gram
    head = np.maximum.accumulate(np.where(new_run, np.arange(len(gram)), 0))
    later = (ids > ids[head]) | (start > start[head])  # rows of a run are sorted by id and start
    repeated = later & (mark == 0)
    group = np.cumsum(new_gram) - 1
    kinds = np.bincount(group, weights=new_run) if len(group) else np.zeros(0)
    several = (kinds > 1)[group] if len(group) else np.zeros(0, bool)
    compare = several & ~repeated & (mark == 0)
    if keep_groups:
        lone = ~several & (mark == 0) & ~later & ~_same_as_before(gram, run, mark, ids, start, copy)
        stand = several & new_gram
        left = lone | stand
        over = (gram[left], run[left], ids[left], start[left], number[left], copy[left], stand[left].astype(np.int64))
    else:
        over = ()
    return (ids[repeated], start[repeated], number[repeated], copy[repeated]), (gram[compare], ids[compare], start[compare], number[compare], copy[compare]), over


def _first_pass(parts: int):
    """documents (row, copy, text bytes) -> (part, kind, blob): kind 0 runs by anchor, kind 1 verdicts by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        rows = 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*found)]
            found.clear()
            repeated, compare, over = settle_runs(*columns, np.zeros(len(columns[0]), np.int64), True)
            over = _by_place(over, 2, 3)
            out = [(p, 0, b) for p, b in _dealt(part_of(over[0], parts), over[0], over[1], *over[2:])] if len(over[0]) else []
            out += [(p, 1, b) for p, b in _verdicts(repeated, compare, parts)]
            return _rows(out)

        for batch in batches:
            ids, copies = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for buffer, ends, place, shift in segments(t.as_py() for t in batch.column(2)):
                first, number, gram, whole = runs_of(buffer, ends)
                at = np.searchsorted(ends, first, "right")
                found.append([gram.view(np.int64), whole.view(np.int64), ids[place[at]], first + shift[at], number, copies[place[at]]])
                rows += len(first)
                if rows >= SETTLE:
                    yield flush()
                    rows = 0
        if found:
            yield flush()

    return run


def _verdicts(repeated, compare, parts: int) -> list[tuple[int, bytes]]:
    """Rows (anchor hash, kind, id, start, number, copy) by document: kind 0 repeated, kind 1 to compare."""
    zeros = np.zeros(len(repeated[0]), np.int64)
    gram = np.concatenate([zeros, compare[0]])
    kind = np.concatenate([zeros, np.ones(len(compare[0]), np.int64)])
    ids, start, number, copy = (np.concatenate([a, b]) for a, b in zip(repeated, compare[1:]))
    order = np.lexsort((start, copy, ids))
    gram, kind, ids, start, number, copy = (c[order] for c in (gram, kind, ids, start, number, copy))
    return _dealt(part_of(ids ^ copy, parts), gram, kind, ids, start, number, copy)


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Blobs of each part by kind, from rows sorted by part."""
    now, held = None, {}
    for batch in batches:
        for part, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if part != now:
                if held:
                    yield now, held
                now, held = part, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


def _second_pass(parts: int):
    """Runs that meet by anchor -> verdicts by document. Verdicts of the first pass go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _grouped(batches):
            if 1 in held:
                yield _rows([(part, 0, b) for b in held[1]])
            if 0 in held:
                repeated, compare, _ = settle_runs(*unpack(held[0], 7), False)
                if len(repeated[0]) + len(compare[0]):
                    yield _rows([(p, 0, b) for p, b in _verdicts(repeated, compare, parts)])

    return run


def spans_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def settle_windows(gram, window, ids, start, copy):
    """Last digit: (ids, starts, copies) of windows that also start earlier, and the rows that stand for the others."""
    order = np.lexsort((copy, start, ids, window, gram))
    gram, window, ids, start, copy = (c[order] for c in (gram, window, ids, start, copy))
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (window[1:] != window[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
    later = (ids > ids[head]) | (start > start[head])
    first = ~later & ~_same_as_before(gram, window, ids, start, copy)
    return (ids[later], start[later], copy[later]), (gram[first], window[first], ids[first], start[first], copy[first])


def _third_pass(parts: int):
    """Verdicts and documents that meet by document -> (part, kind, blob): kind 0 windows by anchor, kind 1 covered
    intervals by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, known = None, [], None
        covers: list[list[np.ndarray]] = []
        windows: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = []
            if windows:
                (ids, start, copy), over = settle_windows(*(np.concatenate(c) for c in zip(*windows)))
                covers.append([ids, start, start + DEPTH, copy])
                over = _by_place(over, 2, 3)
                out = [(p, 0, b) for p, b in _dealt(part_of(over[0], parts), *over)]
            out += [(p, 1, b) for p, b in _intervals(*(np.concatenate(c) for c in zip(*covers)), parts)]
            covers.clear()
            windows.clear()
            return _rows(out)

        for batch in batches:
            for part, kind, did, copy, blob in zip(*(batch.column(n).to_pylist() for n in ("part", "kind", "row", "copy", "blob"))):
                if part != now:
                    now, known, blobs = part, None, []
                if kind == 0:
                    blobs.append(blob)
                    continue
                if known is None:
                    known = unpack(blobs, 6)
                    order = np.lexsort((known[3], known[5], known[2]))
                    known, blobs = [c[order] for c in known], []
                a, b = _rows_of(known, did, copy)
                if a == b:
                    continue
                gram, what, start, number = known[0][a:b], known[1][a:b], known[3][a:b], known[4][a:b]
                sure = what == 0
                first, last = spans_of(start[sure], start[sure] + number[sure] + DEPTH - 1)
                covers.append([np.full(len(first), did), first, last, np.full(len(first), copy)])
                size += len(first)
                if not sure.all():
                    text = zstandard.ZstdDecompressor().decompress(blob)
                    gram, start, number = gram[~sure], start[~sure], number[~sure]
                    fits = start + number + DEPTH - 1 <= len(text)
                    gram, start, number = gram[fits], start[fits], number[fits]
                    each = np.repeat(start, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                    windows.append([np.repeat(gram, number), window_hashes(text, each), np.full(len(each), did), each, np.full(len(each), copy)])
                    size += len(each)
                if size >= SETTLE:
                    yield flush()
                    size = 0
        if covers or windows:
            yield flush()

    return run


def _rows_of(known: list[np.ndarray], did: int, copy: int) -> tuple[int, int]:
    """Where the rows of a document's text lie in columns sorted by id (2) and copy (5)."""
    a, b = np.searchsorted(known[2], did, "left"), np.searchsorted(known[2], did, "right")
    return a + np.searchsorted(known[5][a:b], copy, "left"), a + np.searchsorted(known[5][a:b], copy, "right")


def _intervals(ids: np.ndarray, start: np.ndarray, end: np.ndarray, copy: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Covered intervals by document, neighbouring and overlapping ones as one."""
    order = np.lexsort((start, copy, ids))
    ids, start, end, copy = ids[order], start[order], end[order], copy[order]
    if not len(ids):
        return []
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(end, first)
    zeros = np.zeros(len(first), np.int64)
    return _dealt(part_of(ids[first] ^ copy[first], parts), zeros, zeros, ids[first], start[first], end, copy[first])


def window_hashes(text: bytes, start: np.ndarray) -> np.ndarray:
    """Hash of the window at each start (ascending), segment by segment."""
    out = np.zeros(len(start), np.int64)
    buffer = np.frombuffer(text, np.uint8)
    for at in range(0, len(text), SEGMENT):
        a, b = np.searchsorted(start, at), np.searchsorted(start, at + SEGMENT)
        if a < b:
            pre = prefix(buffer[at : at + SEGMENT + DEPTH - 1])
            out[a:b] = (hashes(pre, start[a:b] - at, DEPTH) >> WINDOW_BITS).view(np.int64)
    return out


def _window_pass(parts: int):
    """Windows that meet by anchor -> (part, kind 1, blob), the covered intervals by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches):
            (ids, start, copy), _ = settle_windows(*unpack(held[0], 5))
            yield _rows([(p, 1, b) for p, b in _intervals(ids, start, start + DEPTH, copy, parts)])

    return run


def _last_pass(with_text: bool):
    """Intervals (kind 0) and documents (kind 1) that meet by document -> the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, known = None, [], None
        for batch in batches:
            rows = []
            for part, kind, doc_id, did, copy, blob in zip(*(batch.column(n).to_pylist() for n in ("part", "kind", "doc_id", "row", "copy", "blob"))):
                if part != now:
                    now, blobs, known = part, [], None
                if kind == 0:
                    blobs.append(blob)
                    continue
                if known is None:
                    known = unpack(blobs, 6)
                    order = np.lexsort((known[5], known[2]))
                    known, blobs = [c[order] for c in known], []
                text = zstandard.ZstdDecompressor().decompress(blob)
                a, b = _rows_of(known, did, copy)
                if with_text and a == b:
                    continue
                start, end = spans_of(known[3][a:b], known[4][a:b])
                kept, at = [], 0
                for s, e in zip(start.tolist(), end.tolist()):
                    kept.append(text[at:s])
                    at = e
                left = b"".join([*kept, text[at:]])
                row = (doc_id, len(text), len(text) - len(left), len(start), hashlib.sha256(left).hexdigest())
                rows.append((*row, hashlib.md5(text).hexdigest(), left.decode(errors="ignore")) if with_text else row)
            if rows:
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_md5", "kept_text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names[: len(rows[0])])

    return run


def _documents(parts: int):
    """(doc_id, row, copy, text) -> the same with the text compressed, and its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            key = np.asarray(batch.column(1)) ^ np.asarray(batch.column(2))
            blobs = [compressor.compress(t.as_py()) for t in batch.column(3)]
            columns = [pa.array(part_of(key, parts)), pa.array(np.ones(len(key), np.int32)), *batch.columns[:3], pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "kind", "doc_id", "row", "copy", "blob"])

    return run


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows (row, t and others) with copy: a hash of t where the rows of an id have several texts, else 0."""
    own = F.xxhash64("t")
    several = cut(rows.groupBy("row").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("row", F.lit(True).alias("several")))
    few = several.count()
    if not few:
        return rows.withColumn("copy", F.lit(0).cast("long"))
    found = rows.join(F.broadcast(several), "row", "left") if few <= BROADCAST else lookup(rows, several, "row", F.col("t"))
    return found.withColumn("copy", F.when(F.col("several"), own.bitwiseOR(F.lit(1).cast("long"))).otherwise(0)).drop("several")


def repeated_passages(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs. with_text: text_md5 (of the input) and
    kept_text too, but only the rows that lost bytes; a character that lost a byte is gone from kept_text."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    rows = _told_apart(rows).select("doc_id", "row", "copy", "t")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART))
    blobs = "part long, kind int, blob binary"
    dealt = lambda df, *then: df.repartition(parts, "part").sortWithinPartitions("part", *then)
    runs = rows.select("row", "copy", "t").mapInArrow(lean(_first_pass(parts)), blobs)
    verdicts = dealt(runs).mapInArrow(lean(_second_pass(parts)), blobs)
    texts = rows.mapInArrow(lean(_documents(parts)), f"part long, kind int, doc_id {kind}, row long, copy long, blob binary")
    both = dealt(texts.unionByName(verdicts, allowMissingColumns=True), "kind")
    # written once, as windows and the intervals found beside them have to come of the same run of a task
    third = stored(both.mapInArrow(lean(_third_pass(parts)), blobs))
    late = dealt(third.where("kind = 0")).mapInArrow(lean(_window_pass(parts)), blobs)
    covers = third.where("kind = 1").unionByName(late).withColumn("kind", F.lit(0))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text_md5 string, kept_text string" * with_text
    return dealt(texts.unionByName(covers, allowMissingColumns=True), "kind").mapInArrow(lean(_last_pass(with_text)), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed from text, n_chars (if there) counted anew, other columns as they are."""
    id_, md5, kept = fresh(docs, "_id", "_md5", "_kept")
    changed = repeated_passages(docs, with_text=True).where("n_removed > 0").select(
        F.col("doc_id").alias(id_), F.col("text_md5").alias(md5), F.col("kept_text").alias(kept)
    ).dropDuplicates([id_, md5])
    joined = docs.join(changed, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.md5(F.col("text").cast("binary")) == F.col(md5)), "left")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(F.col(kept).isNotNull(), F.char_length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return joined.withColumns(new).select(*docs.columns)
