"""Merkle manifest of a dataset, with a proof for each row.

Rows become leaves. The leaves of a group form a tree in which every two consecutive nodes become their digest, the last
alone if need be, until one is left; the trees' roots, in the order of their groups, form one more tree of the same kind.

Nothing meets by group. Rows are dealt to ranges of (group, order), numbered within each range, and the ranges' counts give
each row its index in its group. Trees are built in tiers of TIER levels: 2**TIER consecutive nodes meet in a task and give
all nodes above them in the tier; the topmost ones are the next tier's items. All nodes go to one stored table of
coordinates (group, level, index).

A leaf's proof is looked up by coordinates: from its index and its group's size it explodes the coordinates of the sibling
on each level of the first tier, joins the stored nodes, and puts the digests found in their order. Siblings on higher tiers
are the same for all leaves below one item of that tier, so the items explode their own coordinates, and their proofs are
handed down; a node is thus asked for at most 2**TIER times, however large its group, and no key is hot. A level without a
sibling is a step of its own, in which the digest is hashed alone. Folding goes over these steps, from any leaf.

Defined results: null fields are "-" in a leaf, a null group comes first, and in its group a null id; rows with one id are
ordered by their leaves, and equal rows are leaves of their own; a group of one row is its own subroot, a dataset of one
group has that group's subroot as root; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, stored

#: Levels of a tier: 2**TIER nodes meet at once.
TIER = 10
#: Fixed: the fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it is hashed: its length in bytes and itself, or "-"."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(changes: dict[str, Column]) -> Column:
    """The digest of a row's fields, of which some may have other values."""
    return F.sha2(F.concat(*(field(changes.get(name, F.col(name))) for name in FIELDS)), 256)


def ranked(items: DataFrame, *order: str) -> DataFrame:
    """items (g, order columns that tell all rows of a group apart, and others) with i, the place in the group from 0, and n,
    the group's size; stored."""
    # stored, so that the ranges and what is counted in them stay the same whatever is lost later
    rows = stored(items.repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("g", "part").agg(F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy("g")  # of one row for each range that the group lies in
    before = F.sum("here").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")
    counts = counts.select("g", "part", before.alias("before"), F.sum("here").over(group).alias("n"))
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order))
    numbered = rows.withColumn("place", place).join(counts, ["g", "part"]).withColumn("i", F.col("before") + F.col("place") - 1)
    return stored(numbered.drop("before", "place", "part"))


def _fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of a tier above its items, which come in order: (g, n, i, d) -> (g, n, level, i, d)."""
    kinds = [("g", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("d", pa.binary())]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[name for name, _ in kinds])

    def above(g: str, n: int, block: int, items: list[bytes]) -> Iterator[tuple]:
        hexes, width = [d.hex().encode() for d in items], n
        for level in range(1, TIER + 1):
            if width == 1:
                return
            nodes = [hashlib.sha256(b"".join(hexes[i : i + 2])) for i in range(0, len(hexes), 2)]
            hexes, width = [x.hexdigest().encode() for x in nodes], -(-width // 2)
            for i, x in enumerate(nodes):
                yield g, n, level, (block << TIER - level) + i, x.digest()

    now, size, held, rows = None, 0, [], []
    for batch in batches:
        for g, n, i, d in zip(*(c.to_pylist() for c in batch.columns)):
            if (g, i >> TIER) != now:
                if held:
                    rows += above(now[0], size, now[1], held)
                now, size, held = (g, i >> TIER), n, []
                if len(rows) > 20_000:
                    yield sent(rows)
                    rows = []
            held.append(d)
    if held:
        rows += above(now[0], size, now[1], held)
    yield sent(rows)


def _next_items(nodes: DataFrame) -> DataFrame:
    """The items of the tier above, of the groups that go on there."""
    return nodes.where((F.col("level") == TIER) & (F.col("n") > 1 << TIER)).select("g", F.expr(f"shiftright(n - 1, {TIER}) + 1").alias("n"), "i", "d")


def trees(items: DataFrame) -> list[DataFrame]:
    """The nodes above items (g, n, i, d), a stored table for each tier, lowest first: (g, n, level, i, d), with n, level and i
    counted in the tier's own items."""
    out: list[DataFrame] = []
    while not out or not items.isEmpty():
        dealt = items.select("g", "n", "i", "d").repartition("g", F.shiftright("i", TIER)).sortWithinPartitions("g", "i")
        out.append(stored(dealt.mapInArrow(lean(_fold_blocks), "g string, n long, level int, i long, d binary")))
        items = _next_items(out[-1])
    return out


def _levels(n: str) -> Column:
    """Levels above n items, two or more."""
    return F.length(F.bin(F.col(n) - 1))


def roots(items: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """(g, root) of each group."""
    tops = [nodes.where((F.col("n") <= 1 << TIER) & (F.col("level") == _levels("n"))) for nodes in tiers]
    out = items.where("n = 1").select("g", F.col("d").alias("root"))
    for top in tops:
        out = out.unionByName(top.select("g", F.col("d").alias("root")))
    return out


STEPS = "array<struct<left:boolean,d:binary>>"


def paths(items: DataFrame, tiers: list[DataFrame], over: DataFrame) -> DataFrame:
    """(g, i, path, root) for each of items (g, n, i, d): the steps from it up to its group's root and on. over: (g, more, root),
    the steps above each group. A step has left (whether the sibling comes first) and d, the sibling, null where there is none."""
    steps = items.where("n > 1").select("g", "i", F.explode(F.sequence(F.lit(0), F.least(_levels("n"), F.lit(TIER)) - 1)).alias("level"))
    steps = steps.withColumn("at", F.expr("shiftright(i, level)").bitwiseXOR(F.lit(1).cast("long")))
    nodes = items.select("g", F.lit(0).alias("level"), F.col("i").alias("at"), "d")
    nodes = nodes.unionByName(tiers[0].where(F.col("level") < TIER).select("g", "level", F.col("i").alias("at"), "d"))
    found = steps.join(nodes, ["g", "level", "at"], "left")
    step = F.struct("level", (F.col("at") % 2 == 0).alias("left"), "d")
    low = found.groupBy("g", "i").agg(F.sort_array(F.collect_list(step)).alias("path"))  # TIER steps at most
    low = low.withColumn("path", F.transform("path", lambda s: F.struct(s["left"].alias("left"), s["d"].alias("d"))).cast(STEPS))
    low = low.unionByName(items.where("n = 1").select("g", "i", F.array().cast(STEPS).alias("path"))).withColumn("block", F.shiftright("i", TIER))
    here = items.where((F.col("i") == 0) & (F.col("n") <= 1 << TIER)).select("g", F.lit(0).cast("long").alias("block")).join(over, "g")
    if len(tiers) > 1:
        higher = paths(_next_items(tiers[0]), tiers[1:], over)
        here = here.unionByName(higher.select("g", F.col("i").alias("block"), F.col("path").alias("more"), "root"))
    return low.join(here, ["g", "block"]).select("g", "i", F.concat("path", "more").alias("path"), "root")


def folded(start: Column, path: Column) -> Column:
    """The root, as hexadecimal digits, that a leaf and its steps give."""

    def step(under: Column, s: Column) -> Column:
        other = F.coalesce(F.lower(F.hex(s["d"])), F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(other, under)).otherwise(F.concat(under, other)), 256)

    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, tampered: Column, changes: dict[str, Column]) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row. Where `tampered` holds, the root is
    folded from a leaf in which the fields of `changes` have new values; all else is of the rows as they are."""
    changed = F.when(tampered, F.unhex(leaf(changes)))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("g"), F.unhex(leaf({})).alias("d"), changed.alias("changed"))
    items = ranked(rows.withColumn("row", F.monotonically_increasing_id()), "doc_id", "d", "row")
    tiers = trees(items)
    groups = ranked(roots(items, tiers).select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("root").alias("d")), "group")
    top_tiers = trees(groups)
    top = roots(groups, top_tiers).first()
    root = bytes(top.root) if top else b""
    over = paths(groups, top_tiers, docs.sparkSession.createDataFrame([("", [], root)], f"g string, more {STEPS}, root binary"))
    over = over.join(groups, ["g", "i"]).select(F.col("group").alias("g"), F.col("path").alias("more"), F.col("d").alias("root"))
    found = items.join(paths(items, tiers, over).withColumnRenamed("root", "sub"), ["g", "i"])
    text = lambda c: F.lower(F.hex(c))
    fold = folded(text(F.coalesce("changed", "d")), F.col("path"))
    siblings = F.array_join(F.transform("path", lambda s: F.coalesce(text(s["d"]), F.lit(""))), "")
    out = found.select(
        "doc_id", text("d").alias("leaf"), text("sub").alias("subroot"), F.lit(root.hex()).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), fold.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
