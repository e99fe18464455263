import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import bpe, packing

from .fixtures import cases, documents

RANKS, VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
CODEC = bpe.Codec(bpe.model_bytes(bpe.read_ranks(RANKS)), PATTERN)
TOKENS = packing.Tokens(open(VOCABULARY, encoding="utf-8").read(), PATTERN)
REFERENCE = tiktoken.Encoding(
    "own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={}
)
TOKENIZER = Tokenizer.from_file(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip_and_reference(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_packing_tokens_equal_the_tokenizer(text):
    assert np.frombuffer(TOKENS.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encoded_table(spark):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(documents(spark), RANKS, PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for d, t in cases():
        ids = REFERENCE.encode_ordinary(t or "")
        expected.append((str(d), len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == sorted(expected)
    assert bpe.encoded(documents(spark, []), RANKS, PATTERN).count() == 0


def test_rows_that_repeat_are_dealt_to_buckets(spark, monkeypatch):
    """One row of a document many times over: no bucket holds more than a fair part, and the layout has no gap."""
    monkeypatch.setattr(packing, "BUCKET", 50)
    seen, dealt = [], packing._dealt
    monkeypatch.setattr(packing, "_dealt", lambda rows, buckets: seen.append(dealt(rows, buckets)) or seen[-1])
    out = packing.packed(documents(spark, [(7, "one and the same")] * 600), VOCABULARY, PATTERN, 64)
    rows = sorted((r.sequence_id, r.offset, r.length) for r in out.collect())
    assert len(rows) == 600 and len({r[2] for r in rows}) == 1
    sizes = [r["count"] for r in seen[0].groupBy("bucket").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 100
    each = 64 // rows[0][2]
    assert len({r[0] for r in rows}) == -(-600 // each)
    ends = {}
    for sequence, offset, length in rows:
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length



@pytest.mark.parametrize("capacity", [16, 2048])
def test_packed_table(spark, capacity):
    rows = [tuple(r) for r in packing.packed(documents(spark), VOCABULARY, PATTERN, capacity).collect()]
    expected = []
    for d, t in cases():
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            expected.append((str(d), piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == sorted(expected)
    sequences = {}
    for _, _, _, length, _, sequence, offset in rows:
        sequences.setdefault(sequence, []).append((offset, length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(e[3] for e in expected)
    assert len(sequences) <= -(-total // capacity) + 2
    assert packing.packed(documents(spark, []), VOCABULARY, PATTERN).count() == 0


def fewest(items, capacity):
    """Exact number of bins, by depth-first search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in {*bins}:
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


def test_reduction_loses_no_optimum():
    rng = random.Random(4)
    for _ in range(250):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        counts = {s: items.count(s) for s in set(items)}
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        used = [s for content, times in fixed for s in content * times]
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sorted(used + left) == sorted(items) and all(sum(c) <= capacity for c, _ in fixed)
        assert sum(t for _, t in fixed) + fewest(left, capacity) == fewest(items, capacity)
        plan = packing.plan(counts, capacity)
        assert sorted(s for c, t in plan for s in c * t) == sorted(items) and all(sum(c) <= capacity for c, _ in plan)
