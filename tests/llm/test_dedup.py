import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import components, exact_dedup, simhash, suffix_dedup

from .fixtures import cases, documents


def exact_brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is not None, m[0]))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("hash_of", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact_groups_equal_brute_force_even_with_colliding_hashes(spark, hash_of):
    got = [tuple(r) for r in exact_dedup.exact_groups(documents(spark), hash_of).collect()]
    assert sorted(got, key=str) == exact_brute(cases())


def test_drop_copies_keeps_one_row_of_each_text(spark):
    out = exact_dedup.drop_copies(documents(spark))
    kept = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
    assert len(kept) == len(set(kept)) == len({x[4] for x in exact_brute(cases())})
    assert out.columns == documents(spark).columns


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert suffix_dedup.repeated_passages(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == simhash.one_of_each(empty).count() == suffix_dedup.without_repeats(empty).count() == 0


def slow_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_sets(fps, distance):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_near_duplicates_equal_brute_force(spark):
    rows = cases()
    got = simhash.near_duplicates(documents(spark)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    sets = linked_sets(fps, 3)
    smallest = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            smallest[sets[f]] = min(d, smallest.get(sets[f], d))
    expected = sorted((str(d), f"{f:016x}", smallest.get(sets[f])) for (d, _), f in zip(rows, fps))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("way", ["blocks", "blocks with long keys", "far"])
def test_links_connect_what_close_pairs_connect(spark, way):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:25]:
        for _ in range(4):
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = simhash.far_links(table, 3) if way == "far" else simhash.links_between(table, direct=2 if "long" in way else 32768)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components.roots_of(links).collect()}
    expected = linked_sets(fps, 3)
    assert len({roots.get(f, f) for f in fps}) == len(set(expected.values()))
    groups, seen = {}, {}
    for f in fps:
        groups.setdefault(expected[f], set()).add(roots.get(f, f))
        seen.setdefault(roots.get(f, f), set()).add(expected[f])
    assert all(len(g) == 1 for g in [*groups.values(), *seen.values()])


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1002), (1002, 1001), (1001, 1000), (5000, 5000)]
    roots = {r.node: r.root for r in components.roots_of(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: r for n, r in roots.items() if n <= 200} == {n: 0 for n in range(201)}
    assert roots[1002] == roots[1001] == 1000 and 5000 not in roots


def passages_brute(rows, depth=100):
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        hit = bytearray(len(data))
        for s in range(len(data) - depth + 1):
            first = seen.setdefault(data[s : s + depth], (doc_id, s))
            if first != (doc_id, s):
                hit[s : s + depth] = b"\1" * depth
        kept = bytes(b for b, h in zip(data, hit) if not h)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((doc_id, len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_passages_equal_brute_force(spark):
    got = [tuple(r) for r in suffix_dedup.repeated_passages(documents(spark)).collect()]
    assert sorted(got, key=str) == passages_brute(cases())


def test_repeated_passages_in_small_steps(spark, monkeypatch):
    """Many segments, settlements and partitions give what one of each gives."""
    monkeypatch.setattr(suffix_dedup, "PART", 4096)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(50, 400))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(texts) for _ in range(rng.randrange(1, 5)))) for i in range(80)]
    got = [tuple(r) for r in suffix_dedup.repeated_passages(documents(spark, rows, 7)).collect()]
    assert sorted(got, key=str) == passages_brute(rows)


def test_segments_of_a_long_text(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rng = random.Random(3)
    texts = [bytes(rng.randrange(97, 100) for _ in range(n)) for n in (5000, 99, 100, 101, 950, 0)]
    found = {}
    for buffer, ends, place, shift in suffix_dedup.segments(texts):
        first, number, gram, _ = suffix_dedup.runs_of(buffer, ends)
        at = np.searchsorted(ends, first, "right")
        for f, n, p, s in zip(first, number, place[at], shift[at]):
            for x in range(f + s, f + s + n):
                found[(p, x)] = found.get((p, x), 0) + 1
    assert found == {(p, s): 1 for p, t in enumerate(texts) for s in range(len(t) - 99)}


def test_without_repeats_keeps_other_columns(spark):
    before = {(r.doc_id, r.text): r for r in documents(spark).collect()}
    out = suffix_dedup.without_repeats(documents(spark))
    assert out.columns == documents(spark).columns and out.count() == len(cases())
    spans = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_passages(documents(spark)).collect()}
    for r in out.collect():
        if not spans[r.doc_id]:
            assert (r.doc_id, r.text) in before
        else:
            assert r.n_chars == len(r.text)


def rows_with_ids_that_repeat():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x, tail, y, z = text(300), text(600), text(600), text(250)
    rows = [(0, x), (1, x + tail), (1, y), (2, y[:200] + z), (2, z), (None, text(400)), (None, text(400)), (None, z), (3, x), (3, x), (3, text(90)), (3, text(130) + x)]
    rows += [(4, text(50) + tail), (4, tail)]  # one string at two starts: the smaller one stays
    return rows + [(i, text(20) + rng.choice([x, y, z, tail]) + text(rng.randrange(40))) for i in range(5, 25) for _ in range(2)]


def by_rows(rows, depth=100):
    """As the contract says, row by row: a byte goes if a string over it starts earlier, by (doc_id, start)."""
    key = lambda d: (d is not None, d or 0)
    least = {}
    for d, t in rows:
        for s in range(len(t) - depth + 1):
            w = t[s : s + depth]
            least[w] = min(least.get(w, (key(d), s)), (key(d), s))
    out = []
    for d, t in rows:
        hit = bytearray(len(t))
        for s in range(len(t) - depth + 1):
            if least[t[s : s + depth]] < (key(d), s):
                hit[s : s + depth] = b"\1" * depth
        kept = "".join(c for c, h in zip(t, hit) if not h)
        out.append((str(d), len(t), sum(hit), sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1])), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("way", ["broadcast", "shuffled", "many parts"])
def test_verdicts_belong_to_texts(spark, monkeypatch, way):
    """Texts that share a doc_id keep their own bytes."""
    if way == "shuffled":
        monkeypatch.setattr(suffix_dedup, "BROADCAST", 0)
    if way == "many parts":
        monkeypatch.setattr(suffix_dedup, "PART", 2000)
    rows = rows_with_ids_that_repeat()
    expected = by_rows(rows)
    assert [r for r in expected if r[0] == "1"][1][2] == 0 or [r for r in expected if r[0] == "1"][0][2] == 0
    docs = documents(spark, rows, 5)
    got = [tuple(r) for r in suffix_dedup.repeated_passages(docs).collect()]
    assert sorted((str(r[0]), *r[1:]) for r in got) == [e[:5] for e in expected]
    assert sorted((str(r.doc_id), r.text) for r in suffix_dedup.without_repeats(docs).collect()) == sorted((e[0], e[5]) for e in expected)
