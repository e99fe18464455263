"""SimHash near-duplicates: 64-bit fingerprints of word shingles, pigeonhole blocks, Hamming verification, components.

Fingerprints that differ in at most `distance` bits agree on `agree` of `agree + distance` blocks, whichever those are;
every choice of `agree` blocks is a key, and fingerprints that share a key are compared. Equal fingerprints are one node.
A key shared by up to `direct` distinct fingerprints is settled in one task, which keeps a spanning star of each linked
set, never its pairs. A larger key goes the exact long way round: each of its fingerprints is dealt to all words within
`distance // 2` and within `distance - distance // 2` flips; those that meet at a word are linked to the smallest of the
closer ones, so a meeting has a bounded size whatever the key holds.

Defined results: null text is empty; a text without words has fingerprint zero and links like any other; fewer words than
a shingle make one shingle; rows that repeat a doc_id are linked by their fingerprints like other rows; a null doc_id is
never the smallest unless all are null; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean, lookup, whole_text
from .components import roots_of

SEED = 42
CHUNK = 1 << 16
FULL = (1 << 64) - 1


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 bytes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return digest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    total = len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > total).tolist()))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, md5 (of the text) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()) if batch.column(2).type != pa.binary() else batch.column(2)
            fps = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "md5", "fp"])

    kind, text = dict(docs.dtypes)["doc_id"], whole_text().cast("binary")
    return docs.select("doc_id", F.md5(text).alias("md5"), text.alias("t")).mapInArrow(lean(run), f"doc_id {kind}, md5 string, fp long")


def block_masks(distance: int, agree: int) -> list[int]:
    """Signed masks of every choice of `agree` out of `agree + distance` blocks of a 64-bit word."""
    parts = np.array_split(np.arange(64), agree + distance)
    blocks = [sum(1 << int(i) for i in p) for p in parts]
    masks = [sum(c) for c in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def stars(fps: np.ndarray, distance: int) -> np.ndarray:
    """For distinct unsigned fingerprints the smallest fingerprint of each one's linked set, by breadth-first search."""
    fps = np.sort(fps)
    root = np.zeros(len(fps), np.uint64)
    left = np.arange(len(fps))
    while len(left):
        front, left = left[:1], left[1:]
        start = fps[front[0]]
        root[front] = start
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            step = max(1, (1 << 21) // max(1, len(left)))
            for at in range(0, len(front), step):
                near |= (np.bitwise_count(fps[front[at : at + step], None] ^ fps[None, left]) <= distance).any(axis=0)
            front, left = left[near], left[~near]
            root[front] = start
    return np.stack([fps, root])


def links_between(fps: DataFrame, distance: int = 3, agree: int = 3, direct: int = 32768) -> DataFrame:
    """fps(fp): distinct fingerprints. Links (a, b) that connect exactly what links of at most `distance` bits connect."""
    masks = block_masks(distance, agree)
    keys = fps.select(
        "fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("k")
    )
    counts = cut(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    groups = keys.join(counts.where(F.col("n") <= direct), "k", "left_semi").groupBy("k")
    groups = groups.agg(F.sort_array(F.collect_set("fp")).alias("fps")).select("fps").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for fps in batch.column(0):
                pair = stars(np.asarray(fps.values).view(np.uint64), distance)
                found.append(pair[:, pair[0] != pair[1]])
            pairs = np.concatenate(found, axis=1).view(np.int64) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    links = groups.mapInArrow(lean(run), "a long, b long").distinct()
    hot = counts.where(F.col("n") > direct)
    if not hot.isEmpty():
        links = links.unionByName(far_links(keys.join(hot, "k", "left_semi").select("fp").distinct(), distance))
    return links


def far_links(fps: DataFrame, distance: int) -> DataFrame:
    """The same for keys of any size: meetings at common words, each of bounded size."""
    near, far = distance // 2, distance - distance // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [(sum(1 << i for i in c), r) for r in range(far + 1) for c in combinations(range(64), r)]
        masks = np.array([m for m, _ in flips], np.uint64)
        radius = np.array([r for _, r in flips], np.int32)
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((part[:, None] ^ masks[None, :]).ravel().view(np.int64)),
                        pa.array(np.repeat(part, len(masks)).view(np.int64)),
                        pa.array(np.tile(radius, len(part))),
                    ],
                    names=["word", "fp", "r"],
                )

    met = fps.mapInArrow(run, "word long, fp long, r int")
    closer = F.min(F.when(F.col("r") <= near, F.col("fp")))
    groups = met.groupBy("word").agg(closer.alias("b"), F.collect_set("fp").alias("all")).where("b is not null and size(all) > 1")
    return groups.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()


def linked(nodes: DataFrame, distance: int, agree: int) -> DataFrame:
    """nodes(fp, first), one for each fingerprint, with root, which is the same for all that links connect."""
    nodes = cut(nodes)
    roots = roots_of(links_between(nodes.select("fp"), distance, agree))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return cut(named)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, agree: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable by links."""
    rows = cut(fingerprints(docs, words).select("doc_id", "fp"))
    named = linked(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), distance, agree)
    sets = named.groupBy("root").agg(F.min("first").alias("component_id"))
    where = lookup(named, sets, "root", F.col("fp")).select("fp", "component_id")
    out = lookup(rows, cut(where), "fp", F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, distance: int = 3, agree: int = 3) -> DataFrame:
    """docs without the near copies, with the columns of docs: of each linked set one row stays, of the smallest doc_id and,
    where that has several texts, the one of the smallest MD5. Of rows that repeat both, any one stays."""
    id_, md5 = fresh(docs, "_id", "_md5")
    rows = cut(fingerprints(docs, words))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5")
    named = linked(rows.groupBy("fp").agg(F.min(first).alias("first")), distance, agree)
    kept = named.groupBy("root").agg(F.min("first").alias("first"))
    kept = cut(kept.select(F.col("first.doc_id").alias(id_), F.col("first.md5").alias(md5)))
    own = F.md5(whole_text().cast("binary"))
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (own == F.col(md5)), "left_semi")
    again = rows.groupBy(F.col("doc_id").alias("d"), F.col("md5").alias("m")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.join(kept, F.col("d").eqNullSafe(F.col(id_)) & (F.col("m") == F.col(md5)), "left_semi")
    return out if again.isEmpty() else out.withColumn(md5, own).dropDuplicates(["doc_id", md5]).drop(md5)
