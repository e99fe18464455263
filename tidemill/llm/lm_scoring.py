"""Language-model scores from a weighted backoff automaton.

Words are counted over every training row. The unigram level gives each known word its discounted count's share and the
discounts' sum to all unknown words together. Above it stand all pairs and triples that occur at least `least` times in
training, so the automaton grows with the text, and a count has the same meaning at every size. Contexts are states; an
arc has an absolute-discounting probability, a failure arc the weight that makes the state's probabilities sum to one.
`Automaton` is this in its plain form.

No machine holds the automaton. Documents go in chunks of about CHUNK bytes. One exchange brings a chunk the counts of its
distinct words. A second one sends each distinct (word before, context word, word) of a chunk to its context word's bucket:
all pairs and triples with that word in their middle meet there, so the bucket has the arcs and weights of both levels, and
answers each with the log10 probability of its last word. A context word of many occurrences doesn't meet in one place: its
pairs are counted by an exchange of their own before, dealt by their last words, and its triples meet by pair, a pair of
many occurrences again dealt by its last words. Each exchange's answers are stored and its questions deleted before the next
one begins. A token takes the arc of the longest context that has it, after the failure weights of the longer ones.

Defined results: null text is empty: one token, the end; a null doc_id is in fold 0; repeated rows repeat their result and
count as often as they stand in training; without training rows every token scores 0; an empty table gives an empty
result. Other columns are ignored. No text is cut.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_stored, fold, lean, stored, stored_so_far, whole_text

#: Fewest training occurrences of a pair or triple that has an arc (a parameter).
LEAST = 2
#: Text bytes of a chunk.
CHUNK = 5 << 20
#: Tokens for each bucket of words or contexts; new entries between two sums of a bucket. A context of more than HOT times
#: BUCKET occurrences is dealt to several buckets.
BUCKET, MERGED, HOT = 1 << 20, 1 << 21, 2
#: Word ids have fewer bits; 0 is a word that can't be in an arc, START what stands before a text.
BITS, START = 31, 1
END = b""
DISCOUNT = 0.75


def _wrap(*columns: np.ndarray) -> bytes:
    """Columns of integers, compressed by planes of bytes."""
    flat = np.concatenate(columns).astype(np.int64)
    return zstandard.ZstdCompressor(level=3).compress(flat.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unwrap(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of integers from 0 on, each by as many planes of bytes as its largest needs."""
    head, planes = [], []
    for x in columns:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        kind = next(k for k in (1, 2, 4, 8) if k >= width)
        head += [len(x), width]
        planes.append(x.astype(f"<u{kind}").view(np.uint8).reshape(-1, kind)[:, :width].T.tobytes())
    flat = np.array([len(columns), *head], "<i8").tobytes() + b"".join(planes)
    return zstandard.ZstdCompressor(level=3).compress(flat)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    flat = zstandard.ZstdDecompressor().decompress(blob)
    number = int(np.frombuffer(flat, "<i8", 1)[0])
    out, at = [], 8 + 16 * number
    for n, width in np.frombuffer(flat, "<i8", 2 * number, 8).reshape(-1, 2).tolist():
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(flat, np.uint8, n * width, at).reshape(width, n).T
        out.append(x.view("<i8").ravel())
        at += n * width
    return out


def _words(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ends of the runs of equal numbers in ascending ones."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def _batch(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, schema.values())], names=list(schema))


CHUNKS = {"docs": pa.binary(), "tokens": pa.binary(), "words": pa.binary(), "counts": pa.binary(), "n": pa.int64()}


def _chunks(id_type: pa.DataType, chunk_bytes: int):
    """(doc_id, held_out, text) -> one row for a chunk: its documents with their lengths, the place of each token's word in the
    chunk's distinct words, those words by their hash, their training counts, and the chunk's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lengths, parts, size = [], [], [], [], 0
        number: defaultdict = defaultdict(count().__next__)

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            words = list(number)
            order = np.argsort(np.fromiter(map(zlib.crc32, words), np.int64, len(words)), kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words))
            counts = np.bincount(tokens[np.repeat(~np.array(held), lengths)], minlength=len(words))[order]
            part = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(lengths, pa.int64())], names=["doc_id", "held_out", "length"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            joined = zstandard.ZstdCompressor(level=3).compress(b"\n".join([words[i] for i in order.tolist()]))
            row = (sink.getvalue().to_pybytes(), _wrap(place[tokens]), joined, _wrap(counts), len(tokens))
            for x in (ids, held, lengths, parts, number):
                x.clear()
            number.default_factory = count().__next__
            return _batch([row], CHUNKS)

        for batch in batches:
            for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.lower().split()
                words.append(END)
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(words))
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                size += len(text)
                if size >= chunk_bytes:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    return run


ASKED = {"bucket": pa.int64(), "chunk": pa.int64(), "words": pa.binary(), "counts": pa.binary()}


def _word_questions(buckets: int):
    """Chunks (chunk, words, counts) -> their words and training counts by bucket, a range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for chunk, blob, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts = _words(blob), _unwrap(numbers)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * buckets >> 32
                yield _batch([(int(bucket[a]), chunk, compress(b"\n".join(words[a:b])), _wrap(counts[a:b])) for a, b in _slices(bucket)], ASKED)

    return run


KNOWN = {"chunk": pa.int64(), "bucket": pa.int64(), "blob": pa.binary(), "kinds": pa.int64(), "once": pa.int64(), "twice": pa.int64(), "ends": pa.int64(), "top": pa.int64(), "train": pa.int64(), "most": pa.int64()}


def _word_answers(least: int, buckets: int):
    """Questions sorted by bucket -> for each the training counts and ids of its words, and a row of the bucket's own sums. A
    word of fewer than `least` occurrences is in no arc and has no id."""

    def settle(bucket: int, asked: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        get = total.get
        for _, blob, numbers in asked:
            for w, n in zip(_words(blob), _unwrap(numbers).tolist()):
                if n:
                    total[w] = get(w, 0) + n
        counts = np.fromiter(total.values(), np.int64, len(total))
        # frequent words first: they fill questions, and small numbers pack well
        ids = dict(zip(sorted((w for w, n in total.items() if n >= least), key=lambda w: (-total[w], zlib.crc32(w), w)), count(1)))
        for chunk, blob, _ in asked:
            words = _words(blob)
            own = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            named = np.fromiter((ids.get(w, 0) for w in words), np.int64, len(words))
            yield _batch([(chunk, bucket, _packed(own, named), 0, 0, 0, 0, 0, 0, 0)], KNOWN)
        sums = (len(total), int((counts == 1).sum()), int((counts == 2).sum()), get(END, 0), _spread(len(ids) + 1, bucket, buckets), int(counts.sum()), int(counts.max(initial=0)))
        yield _batch([(None, bucket, None, *sums)], KNOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if own:
                        yield from settle(now, own)
                    now, own = bucket, []
                own.append(rest)
        if own:
            yield from settle(now, own)

    return run


def _spread(number, bucket, buckets: int):
    """An id above START from a number from 1 on within its bucket."""
    return START + 1 + (number - 1) * buckets + bucket


def _documents_of(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_next_batch()


def _dealt(context: np.ndarray, sub: np.ndarray, buckets: int) -> np.ndarray:
    x = (context.astype(np.uint64) + sub.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class Asked:
    """The distinct (context, word) of a chunk's places, ordered by bucket, context and word; word 0 has no arc.
    A context of more than `hot` occurrences is dealt to several buckets by its words; its sums are asked of all of them."""

    def __init__(self, at: np.ndarray, contexts: np.ndarray, total: np.ndarray, word: np.ndarray, train: np.ndarray, lower: np.ndarray, buckets: int, hot: int, by_word: bool):
        """For each place the number of its context in contexts (ids) and total (their occurrences), its word, whether it
        counts, and its count one level below; by_word: which the word gives."""
        used = np.flatnonzero(np.bincount(at, minlength=len(contexts)))
        used = used[np.argsort(contexts[used])]
        rank = np.zeros(len(contexts), np.int64)
        rank[used] = np.arange(len(used))
        self.at, contexts, parts = rank[at], contexts[used], 1 + total[used] // hot
        key = self.at << BITS | word
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = np.diff(key[order]) != 0
        first = np.flatnonzero(new)
        entry = np.empty(len(key), np.int64)
        entry[order] = np.cumsum(new) - 1
        owner, word = self.at[order[first]], word[order[first]]
        n = np.add.reduceat(train[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        low = lower[order[first]]
        sub = (word * 0x9E3779B1 >> 16 & 0x7FFFFFFF) % parts[owner]
        split = np.flatnonzero(parts > 1)
        rest = np.repeat(split, parts[split])  # a hot context is asked for in each of its buckets
        each = np.arange(len(rest)) - np.repeat(np.cumsum(parts[split]) - parts[split], parts[split])
        zeros = np.zeros(len(rest), np.int64)
        owner, sub = np.concatenate([owner, rest]), np.concatenate([sub, each])
        bucket = _dealt(contexts[owner], sub, buckets)
        group = bucket * max(1, len(contexts)) + owner
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.entry = place[entry]
        self.owner, self.bucket = owner[order], bucket[order]
        self.word, self.n, self.low = (np.concatenate([x, zeros])[order] for x in (word, n, low))
        self.leads = np.ones(len(order), bool)
        self.leads[1:] = np.diff(group[order]) != 0
        self.contexts, self.by_word = contexts, by_word

    def packed(self) -> Iterator[tuple[int, bytes]]:
        for a, b in _slices(self.bucket):
            first = np.flatnonzero(self.leads[a:b])
            ids, sizes = self.contexts[self.owner[a:b][first]], np.diff(np.append(first, b - a))
            word, low, names = self.word[a:b], self.low[a:b], np.zeros(0, np.int64)
            if self.by_word:  # a word and the count below it are named once
                names, named, word = np.unique(word, return_index=True, return_inverse=True)
                low = low[named]
            yield int(self.bucket[a]), _wrap([len(first), b - a], np.diff(ids, prepend=0), sizes, self.n[a:b], word, np.diff(names, prepend=0), low)

    def answered(self, answers: list) -> np.ndarray:
        """For each place: the arc's count or 0, then the kept arcs' count, number and lower sum of its context, and all its
        occurrences."""
        if not len(self.bucket):
            return np.zeros((5, 0), np.int64)
        counts, sums = [], []
        for blob in (x["blob"] for x in sorted(answers, key=lambda x: x["bucket"])):
            x = _unwrap(blob)
            counts.append(x[1 + 4 * x[0] :])
            sums.append(x[1 : 1 + 4 * x[0]].reshape(4, -1))
        found = np.zeros((4, len(self.contexts)), np.int64)
        parts, owner = np.concatenate(sums, axis=1), self.owner[self.leads]
        for i in range(4):
            np.add.at(found[i], owner, parts[i])
        return np.concatenate([np.concatenate(counts)[None, self.entry], found[:, self.at]])


class Middles:
    """The distinct (context word, word before, word) of a chunk's places, ordered by the context word's bucket and by these.
    Words and their counts are named once for a bucket; the first name, with id 0, is for what is in no arc."""

    def __init__(self, words: np.ndarray, middle: np.ndarray, before: np.ndarray, word: np.ndarray, train: np.ndarray, buckets: int):
        """words: counts and ids; for each place the numbers of its words in that, and whether it counts."""
        order = np.argsort(words[1], kind="stable")
        self.counts, self.ids = words[:, order]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        size, none = len(order), np.int64(0)
        if not size or self.ids[0]:
            raise ValueError("the first word must have no id")
        number[words[1] == 0] = none
        bucket = _dealt(self.ids, np.zeros(size, np.int64), buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(size, np.int64)
        rank[by_bucket] = np.arange(size)
        middle, before, word = number[middle], number[before], number[word]
        key = rank[middle] * size + before
        if size >= 1 << 21:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + word
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        self.entry = np.empty(len(key), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.n = np.add.reduceat(train[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        first = order[first]
        self.middle, self.before, self.word = middle[first], before[first], word[first]
        self.bucket = bucket[self.middle]

    def packed(self) -> Iterator[tuple[int, bytes]]:
        place = np.zeros(len(self.ids), np.int64)
        for a, b in _slices(self.bucket):
            seen = np.zeros(len(self.ids), bool)
            seen[0] = seen[self.before[a:b]] = seen[self.word[a:b]] = True
            names = np.flatnonzero(seen)
            place[names] = np.arange(len(names))
            first = np.flatnonzero(np.diff(self.middle[a:b], prepend=-1))
            middles, sizes = self.ids[self.middle[a:b][first]], np.diff(np.append(first, b - a))
            columns = (place[self.before[a:b]], place[self.word[a:b]], self.n[a:b], np.diff(self.ids[names], prepend=0), self.counts[names])
            yield int(self.bucket[a]), _packed(np.diff(middles, prepend=0), sizes, *columns)

    def answered(self, answers: list) -> np.ndarray:
        """For each place the log10 probability of its word, without the unigram level's part of a word in no arc."""
        values = [np.zeros(0)]
        for blob in (x["blob"] for x in sorted(answers, key=lambda x: x["bucket"])):
            code, value = _unpacked(blob)
            values.append(value.view(np.float64)[code])
        return np.concatenate(values)[self.entry]


def _around(asked: list[tuple[int, bytes]], least: int, level: Unigrams) -> Iterator[tuple[int, bytes]]:
    """All questions (chunk, blob) of Middles for one bucket, answered: for each entry its log10 probability."""
    questions = [(chunk, *_unpacked(blob)) for chunk, blob in asked]
    words, at = np.unique(np.concatenate([np.cumsum(q[6]) for q in questions]), return_inverse=True)
    low = np.zeros(len(words), np.int64)
    low[at] = np.concatenate([q[7] for q in questions])
    low[0] = 0
    contexts, context = np.unique(np.concatenate([np.cumsum(q[1]) for q in questions]), return_inverse=True)
    context = np.repeat(context, np.concatenate([q[2] for q in questions]))
    shift = np.repeat(np.cumsum([0, *(len(q[6]) for q in questions)])[:-1], [len(q[3]) for q in questions])
    before, word = at[shift + np.concatenate([q[3] for q in questions])], at[shift + np.concatenate([q[4] for q in questions])]
    n, ends = np.concatenate([q[5] for q in questions]), np.cumsum([0, *(len(q[3]) for q in questions)])
    chunks, size = [q[0] for q in questions], len(words)
    del questions, shift, at

    key = context * size + before
    if len(contexts) * size * size >= 1 << 63:
        key = np.unique(key, return_inverse=True)[1]
    key = key * size + word
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    entry = np.empty(len(key), np.int64)
    entry[order] = np.cumsum(new) - 1
    n = np.add.reduceat(n[order], first)
    first = order[first]
    context, before, word = context[first], before[first], word[first]
    del key, new, order, first

    # pairs (context, word)
    pair, at = np.unique(context * size + word, return_inverse=True)
    owner, last = np.divmod(pair, size)
    total = _sums(context, n, len(contexts))
    count = _sums(at, n, len(pair))
    kept = (count >= least) & (last > 0)
    found = [None, *(_sums(owner[kept], x, len(contexts)) for x in (count[kept], np.ones(kept.sum(), np.int64), low[last[kept]]))]
    below = (found[3] - level.discount * found[2]) / max(1, level.tokens)
    value = _weight(found, total, below)[owner] + np.where(last > 0, level.model(low[last]), 0)
    value[kept] = np.log10((count[kept] - DISCOUNT) / total[owner[kept]])

    # triples; those of a pair follow each other
    pair = np.cumsum(np.diff(context * size + before, prepend=-1) != 0) - 1
    kinds = int(pair[-1]) + 1
    arc, own = (n >= least) & (word > 0) & (before > 0), _sums(pair, n, kinds)
    found = [None, *(_sums(pair[arc], x, kinds) for x in (n[arc], np.ones(arc.sum(), np.int64), count[at[arc]]))]
    head = np.flatnonzero(np.diff(pair, prepend=-1))
    below = (found[3] - DISCOUNT * found[2]) / np.maximum(1, total[context[head]])
    out = value[at] + _weight(found, own, below)[pair]
    out[arc] = np.log10((n[arc] - DISCOUNT) / own[pair[arc]])
    for chunk, a, b in zip(chunks, ends, ends[1:]):
        values, code, times = np.unique(out[entry[a:b]], return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # small codes for frequent values
        small = np.empty(len(order), np.int64)
        small[order] = np.arange(len(order))
        yield chunk, _packed(small[code], values[order].view(np.uint64))


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, values, size).astype(np.int64)


def _entries(blob: bytes, by_word: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A question's contexts, the size of each one's group, and its columns word, n, low."""
    x = _unwrap(blob)
    groups, rows = x[:2].tolist()
    ids, sizes, n, word, rest = np.split(x[2:], np.cumsum([groups, groups, rows, rows]))
    if by_word:
        names, low = np.cumsum(rest[: len(rest) // 2]), rest[len(rest) // 2 :]
        word, rest = names[word], low[word]
    return np.cumsum(ids), sizes, np.stack([word, n, rest])


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Columns context, word, count, lower; equal (context, word) become one."""
    x = np.concatenate(parts, axis=1)
    if not x.shape[1]:
        return x
    contexts, at = np.unique(x[0], return_inverse=True)
    key = at << BITS | x[1]
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    return np.stack([x[0, order[first]], x[1, order[first]], np.add.reduceat(x[2, order], first), np.maximum.reduceat(x[3, order], first)])


def _answers(asked: list[tuple[int, bytes]], least: int, pairs: bool) -> Iterator[tuple[int, bytes]]:
    """All questions (chunk, blob) of Asked for one bucket, answered: number of contexts, their sums, for each entry the count
    of its arc. Questions stay packed; what is summed are distinct arcs."""
    parts, size = [np.zeros((4, 0), np.int64)], 0
    for _, blob in asked:
        ids, sizes, columns = _entries(blob, pairs)
        counted = columns[1] > 0
        parts.append(np.concatenate([np.repeat(ids, sizes)[None, counted], columns[:, counted]]))
        size += parts[-1].shape[1]
        if size >= max(MERGED, parts[0].shape[1]):
            parts, size = [_summed(parts)], 0
    context, word, n, low = _summed(parts)
    first = np.flatnonzero(np.diff(context, prepend=-1))
    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
    kept = (n >= least) & (word > 0)
    # a last row that nothing equals
    contexts, key = np.append(context[first], -1), np.append(at[kept] << BITS | word[kept], -1)
    sums = [_sums(at[kept], x, len(contexts)) for x in (n[kept], np.ones(kept.sum(), np.int64), low[kept])]
    sums, n = np.stack([*sums, _sums(at, n, len(contexts))]), np.append(n[kept], 0)
    for chunk, blob in asked:
        ids, sizes, columns = _entries(blob, pairs)
        at = np.searchsorted(contexts[:-1], ids)
        at = np.where(contexts[at] == ids, at, len(contexts) - 1)
        asks = np.repeat(at, sizes) << BITS | columns[0]
        place = np.searchsorted(key[:-1], asks)
        yield chunk, _wrap([len(ids)], *sums[:, at], np.where(key[place] == asks, n[place], 0))


#: Kinds of questions: all around a context word; pairs and triples where it has many occurrences.
AROUND, PAIRS, TRIPLES = 1, 2, 3
ASKED_GRAMS = "bucket long, chunk long, kind int, blob binary"


def _asked(chunk: int, kind: int, own: Asked | Middles) -> pa.RecordBatch:
    rows = [(bucket, chunk, kind, blob) for bucket, blob in own.packed()]
    return _batch(rows, {"bucket": pa.int64(), "chunk": pa.int64(), "kind": pa.int32(), "blob": pa.binary()})


def _exchange(asked: DataFrame, least: int, level: Unigrams) -> DataFrame:
    """asked(bucket, chunk, kind, blob) -> the answers (chunk, bucket, kind, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"chunk": pa.int64(), "bucket": pa.int64(), "kind": pa.int32(), "blob": pa.binary()}
        now, own = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for chunk, blob in _around(own, least, level) if now[1] == AROUND else _answers(own, least, now[1] == PAIRS):
                yield _batch([(chunk, *now, blob)], schema)

        for batch in batches:
            for bucket, chunk, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, kind) != now:
                    if own:
                        yield from out()
                    now, own = (bucket, kind), []
                own.append((chunk, blob))
        if own:
            yield from out()

    met = asked.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return met.mapInArrow(lean(run), "chunk long, bucket long, kind int, blob binary")


def _by_chunk(answers: DataFrame, name: str) -> DataFrame:
    """chunk and the list of its answers, which the chunk bounds."""
    columns = [c for c in answers.columns if c != "chunk"]
    return answers.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias(name))


class Chunk:
    """The places of a chunk: for each text START and then its tokens."""

    def __init__(self, docs: bytes, tokens: bytes, known: list, starts: int, level: Unigrams, buckets: int):
        """known: counts and numbers of the chunk's words by bucket."""
        self.docs, self.level, self.buckets = _documents_of(docs), level, buckets
        lengths = np.asarray(self.docs.column(2)).astype(np.int64) + 1
        self.begin = np.cumsum(lengths) - lengths
        self.inside = np.ones(int(lengths.sum()), bool)
        self.inside[self.begin] = False
        parts = []
        for x in sorted(known, key=lambda x: x["bucket"]):
            n, number = _unpacked(x["blob"])
            parts.append(np.stack([n, np.where(number > 0, _spread(number, x["bucket"], buckets), 0)]))
        words = np.concatenate([*parts, np.array([[starts], [START]])], axis=1)
        self.words = words  # the last one is START
        self.at = np.full(len(self.inside), words.shape[1] - 1, np.int64)
        self.at[self.inside] = _unwrap(tokens)
        self.count, self.id = words[:, self.at]
        self.train = np.repeat(~np.asarray(self.docs.column(1)), lengths)

    def around(self, hot: int) -> tuple[np.ndarray, Middles]:
        """Last places of pairs whose first word is not hot, and what is asked for them and the words before."""
        last = np.flatnonzero((self.id[:-1] > 0) & (self.count[:-1] <= hot) & self.inside[1:]) + 1
        unknown = self.words.shape[1]
        words = np.concatenate([self.words, [[0], [0]]], axis=1)
        before = np.where(self.inside[last - 1], self.at[last - 2], unknown)
        return last, Middles(words, self.at[last - 1], before, self.at[last], self.train[last], self.buckets)

    def pairs(self, hot: int) -> tuple[np.ndarray, Asked]:
        """Last places of pairs whose first word is hot, and what is asked for them."""
        last = np.flatnonzero((self.id[:-1] > 0) & (self.count[:-1] > hot) & self.inside[1:]) + 1
        return last, Asked(self.at[last - 1], self.words[1], self.words[0], self.id[last], self.train[last], self.count[last], self.buckets, hot, True)

    def hot_part(self, hot: int) -> bytes:
        """The places that pairs() and triples() look at, each run of them after a place of no word."""
        first = np.flatnonzero((self.id[:-1] > 0) & (self.count[:-1] > hot) & self.inside[1:])
        need = np.zeros(len(self.at), bool)
        need[first] = need[first + 1] = need[np.maximum(first - 1, 0)] = True
        places = np.flatnonzero(need)
        gaps = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        used, at = np.unique(np.insert(self.at[places], gaps, self.words.shape[1]), return_inverse=True)
        words = np.concatenate([self.words, [[0], [0]]], axis=1)[:, used]
        return _packed(*words, at, np.insert(self.inside[places], gaps, False), np.insert(self.train[places], gaps, False))

    def with_pairs(self, last: np.ndarray, found: np.ndarray) -> None:
        """Sets each place's count as the end of such a pair, if kept, and log10 of its last word's failure weight."""
        self.pair, self.fail = np.zeros(len(self.at), np.int64), np.zeros(len(self.at))
        self.pair[last] = found[0]
        below = (found[3] - self.level.discount * found[2]) / max(1, self.level.tokens)
        self.fail[last] = _weight(found, self.count[last - 1], below)

    def triples(self, hot: int) -> tuple[np.ndarray, Asked]:
        """Last places of triples whose second word is hot, and what is asked for them. A pair can be hot if both its words
        are, and then its count is known."""
        last = np.flatnonzero((self.id[:-2] > 0) & (self.id[1:-1] > 0) & (self.count[1:-1] > hot) & self.inside[1:-1] & self.inside[2:]) + 2
        contexts, first, at = np.unique(self.id[last - 1] << BITS | self.id[last - 2], return_index=True, return_inverse=True)
        word = np.where(self.pair[last] > 0, self.id[last], 0)
        return last, Asked(at, contexts, self.pair[last - 1][first], word, self.train[last], self.pair[last], self.buckets, hot, False)

    def scores(self, around: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """A score for each text, of the places of around() and triples() and what was found for them."""
        unigram = self.level.model(self.words[0])[self.at]
        value = self.fail + unigram
        two = np.flatnonzero(self.pair)
        value[two] = np.log10((self.pair[two] - DISCOUNT) / self.count[two - 1])
        last, found = triples
        below = (found[3] - DISCOUNT * found[2]) / self.count[last - 1]
        value[last] += _weight(found, found[4], below)
        three = found[0] > 0
        value[last[three]] = np.log10((found[0, three] - DISCOUNT) / found[4, three])
        last, found = around
        value[last] = found + np.where(self.id[last] > 0, 0, unigram[last])
        return self.sums(value)

    def sums(self, value: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.where(self.inside, value, 0), self.begin)


class HotPart(Chunk):
    """A chunk's places around words of many occurrences, without its texts."""

    def __init__(self, blob: bytes, level: Unigrams, buckets: int):
        self.level, self.buckets = level, buckets
        *words, self.at, inside, train = _unpacked(blob)
        self.words, self.inside, self.train = np.stack(words), inside > 0, train > 0
        self.count, self.id = self.words[:, self.at]


def _weight(found: np.ndarray, total: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log10 of the failure weights of contexts with this count; 0 where a context has no arc."""
    own = (found[1] - DISCOUNT * found[2]) / np.maximum(total, 1)
    return np.where(found[2] > 0, np.log10(np.maximum(1e-12, 1 - own) / np.maximum(1e-12, 1 - below)), 0.0)


class Automaton:
    """States are contexts: () is 0, then words, then pairs. arcs[state][word] = (log10 probability, next state)."""

    def __init__(self, unigram: np.ndarray, totals: np.ndarray, starts: int, grams: dict[int, dict[tuple[int, ...], int]]):
        """unigram and totals: probability and training count of each frequent word by number (from 1); starts: training
        documents; grams: counts of pairs and triples, a triple's both pairs among them."""
        self.start_word = len(unigram)
        self.totals = totals
        followers: dict[tuple[int, ...], dict[int, int]] = {}
        for order in (2, 3):
            for gram, n in grams[order].items():
                followers.setdefault(gram[:-1], {})[gram[-1]] = n
        self.states: dict[tuple[int, ...], int] = {(): 0}
        for context in sorted(followers, key=lambda c: (len(c), c)):
            self.states[context] = len(self.states)
        self.fail = [0] * len(self.states)
        self.weight = [0.0] * len(self.states)
        self.arcs: list[dict[int, tuple[float, int]]] = [{} for _ in self.states]
        probability: dict[tuple[int, ...], dict[int, float]] = {}
        for context, state in self.states.items():
            if not context:
                continue
            total = self._total(context, starts, grams)
            lower = context[1:]
            while lower and lower not in self.states:
                lower = lower[1:]
            own = {w: (n - DISCOUNT) / total for w, n in followers[context].items() if n > DISCOUNT}
            below = sum(self._lower(lower, w, unigram, probability) for w in own)
            rest = max(1e-12, 1 - sum(own.values())) / max(1e-12, 1 - below)
            self.fail[state] = self.states[lower]
            self.weight[state] = math.log10(rest)
            probability[context] = own
            self.arcs[state] = {w: (math.log10(p), self._next(context, w)) for w, p in own.items()}
        self.after = {w: self._next((), w) for w in range(1, self.start_word)}
        self.start = self.states.get((self.start_word,), 0)
        self.memo: dict[tuple[int, int], tuple[float, bool, int]] = {}

    def _total(self, context: tuple[int, ...], starts: int, grams) -> int:
        if len(context) == 2:
            return grams[2][context]
        return starts if context[0] == self.start_word else int(self.totals[context[0]])

    def _next(self, context: tuple[int, ...], word: int) -> int:
        longest = (*context, word)[-2:]
        while longest and longest not in self.states:
            longest = longest[1:]
        return self.states[longest]

    def _lower(self, context, word: int, unigram, probability) -> float:
        weight = 1.0
        while context:
            if word in probability[context]:
                return weight * probability[context][word]
            state = self.states[context]
            weight *= 10 ** self.weight[state]
            context = next(c for c in (context[1:], ()) if c in self.states)
        return weight * unigram[word]

    def step(self, state: int, word: int) -> tuple[float, bool, int]:
        """What the token adds, whether its unigram comes on top, and the next state."""
        key = (state, word)
        if (found := self.memo.get(key)) is None:
            if len(self.memo) > 150_000:
                self.memo.clear()
            added = 0.0
            while state and word not in self.arcs[state]:
                added += self.weight[state]
                state = self.fail[state]
            if state:
                value, then = self.arcs[state][word]
                found = (added + value, False, then)
            else:
                found = (added, True, self.after.get(word, 0))
            self.memo[key] = found
        return found

    def score(self, words: list[int], unigrams: list[float]) -> float:
        total, state, memo = 0.0, self.start, self.memo
        for word, unigram in zip(words, unigrams):
            found = memo.get((state, word)) or self.step(state, word)
            total += found[0] + unigram if found[1] else found[0]
            state = found[2]
        return total


def build(unigram: np.ndarray, totals: np.ndarray, starts: int, grams: dict[int, dict[tuple[int, ...], int]]) -> Automaton:
    kept = {2: grams[2], 3: {g: n for g, n in grams[3].items() if g[:2] in grams[2] and g[1:] in grams[2]}}
    return Automaton(unigram, totals, starts, kept)


def _kept(df: DataFrame) -> DataFrame:
    """stored(df), after which Spark deletes the shuffle files of the job: what follows reads the table."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return stored(df)
    finally:
        conf.set(name, before)


class Unigrams:
    """log10 shares of a word with count c: the model's, and the base's (c + 0.5) / (N + 0.5 (V + 1))."""

    def __init__(self, tokens: int, kinds: int, once: int, twice: int):
        self.tokens, self.kinds = tokens, kinds
        self.discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def model(self, c: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.zeros(len(c))
        unknown = self.discount * self.kinds / self.tokens
        return np.log10(np.where(c > 0, (c - self.discount) / self.tokens, unknown))


def scores(docs: DataFrame, folds: int = 5, held: int = 1, least: int = LEAST, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", (fold(folds) == held).alias("held_out"), whole_text().cast("binary").alias("t"))
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    chunks = rows.mapInArrow(lean(_chunks(id_type, chunk_bytes)), "docs binary, tokens binary, words binary, counts binary, n long")
    since = stored_so_far()
    chunks = stored(chunks.withColumn("chunk", F.monotonically_increasing_id()))
    buckets, hot = 1 + chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BUCKET, HOT * BUCKET

    asked = chunks.select("chunk", "words", "counts").mapInArrow(lean(_word_questions(buckets)), "bucket long, chunk long, words binary, counts binary")
    met = asked.repartition("bucket").sortWithinPartitions("bucket")
    sums = "kinds long, once long, twice long, ends long, top long, train long, most long"
    known = _kept(met.mapInArrow(lean(_word_answers(least, buckets)), f"chunk long, bucket long, blob binary, {sums}"))
    total = [F.coalesce(F.sum(x), F.lit(0)) for x in ("train", "kinds", "once", "twice", "ends")]
    largest = [F.coalesce(F.max(x), F.lit(y)) for x, y in (("top", START + 1), ("most", 0))]
    tokens, kinds, once, twice, starts, top, most = known.where("chunk is null").agg(*total, *largest).first()
    if top >= 1 << BITS:
        raise ValueError("too many distinct words for their ids")
    level = Unigrams(tokens, kinds, once, twice)
    words = _by_chunk(known.where("chunk is not null").select("chunk", "bucket", "blob"), "known")
    numbered = _kept(chunks.select("chunk", "docs", "tokens").join(words, "chunk"))
    clear_stored(docs.sparkSession, since, keep=1)  # numbered has what is still needed of them

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, *columns = (c[i].as_py() for c in batch.columns)
                chunk = Chunk(*columns, starts, level, buckets)
                yield _asked(number, AROUND, chunk.around(hot)[1])
                yield _asked(number, PAIRS, chunk.pairs(hot)[1])

    def hot_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, *columns = (c[i].as_py() for c in batch.columns)
                yield _batch([(number, Chunk(*columns, starts, level, buckets).hot_part(hot))], {"chunk": pa.int64(), "part": pa.binary()})

    def with_pairs(chunk: Chunk, answers: list) -> Chunk:
        last, asked = chunk.pairs(hot)
        chunk.with_pairs(last, asked.answered([x for x in answers if x["kind"] == PAIRS]))
        return chunk

    def triple_questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, part, answers = (c[i].as_py() for c in batch.columns)
                yield _asked(number, TRIPLES, with_pairs(HotPart(part, level, buckets), answers).triples(hot)[1])

    found = _kept(_exchange(numbered.mapInArrow(lean(questions), ASKED_GRAMS), least, level))
    if max(most, starts) > hot:
        parts = numbered.mapInArrow(lean(hot_parts), "chunk long, part binary")
        paired = parts.join(_by_chunk(found.where(F.col("kind") == PAIRS), "answers"), "chunk")
        found = found.union(_kept(_exchange(paired.mapInArrow(lean(triple_questions), ASKED_GRAMS), least, level)))
    answered = numbered.join(_by_chunk(found, "answers"), "chunk", "left").select("docs", "tokens", "known", "answers")

    def answer(*columns) -> pa.RecordBatch:
        *columns, answers = columns
        answers = answers or []
        chunk = with_pairs(Chunk(*columns, starts, level, buckets), answers)
        around, triples = chunk.around(hot), chunk.triples(hot)
        around, triples = ((last, own.answered([x for x in answers if x["kind"] == kind])) for kind, (last, own) in ((AROUND, around), (TRIPLES, triples)))
        score = chunk.scores(around, triples)
        found = chunk.sums((chunk.count > 0).astype(np.int64))
        base = chunk.sums(level.base(chunk.words[0])[chunk.at])
        columns = [chunk.docs.column(0), chunk.docs.column(1), chunk.docs.column(2), pa.array(found, pa.int64())]
        columns += [pa.array(np.full(len(base), tokens), pa.int64()), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield answer(*(c[i].as_py() for c in batch.columns))

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered.mapInArrow(lean(run), schema)
