"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in regions and shards in racks; a node weighs as much as the shards below it. A row descends:
among the regions, then the racks of its region, then the shards of its rack, it takes the child with the smallest
draw -ln(u) / weight, u a hash of the row's key and the child. So each child is chosen in proportion to its weight, a row makes
as many draws as the nodes on its way have children, and work grows with the depth of the tree and not with its shards.

Where a shard's weight changes, its region and rack change theirs by as much. A node that grows only takes rows, one
that shrinks only gives rows, and rows move nowhere but into, out of and within subtrees whose weight changed. :func:`grown`
adds a shard in a region of its own, so that it takes rows only into itself.

The law is ``key``: id and tree decide. Slots number a shard's rows from 0 without gaps, by a fixed number of
hash buckets and then by id, so that no shard meets in one task.

Defined results: a null id draws as the word null; a null text has size 8 and the checksum of no bytes; rows that
repeat get slots of their own; shards without weight take no rows; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked

BUCKETS = 4096


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def uniform_tree(shards: int, racks: int = 3, per_rack: int = 4) -> list[Shard]:
    """Shards 0..n-1 in order: ``per_rack`` to a rack, ``racks`` to a region; more of them never move earlier ones."""
    return [Shard(i, i // (racks * per_rack), i // per_rack) for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and a rack of its own."""
    return [*tree, Shard(max(s.number for s in tree) + 1, max(s.region for s in tree) + 1, 0, weight)]


def _children(tree: list[Shard]) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level: parent's path -> (path, weight) of its children, in order."""
    paths = [("", f"{s.region}", f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}", s.weight) for s in tree if s.weight > 0]
    out = []
    for level in range(3):
        of: dict[str, dict[str, float]] = {}
        for p in paths:
            node = of.setdefault(p[level], {})
            node[p[level + 1]] = node.get(p[level + 1], 0.0) + p[4]
        out.append({k: list(v.items()) for k, v in of.items()})
    return out


def draw(key: Column, node: Column, weight: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("@"), node)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return -F.ln(u) / weight


def descend(rows: DataFrame, tree: list[Shard], key: str, into: str) -> DataFrame:
    """``rows`` with the column ``into``: the number of the shard that each row reaches."""
    out = rows.withColumn(into, F.lit(""))
    for children in _children(tree):
        table = F.create_map(*[x for parent, nodes in children.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in nodes]))])
        drawn = F.transform(F.element_at(table, F.col(into)), lambda c: F.struct(draw(F.col(key), c["node"], c["weight"]).alias("draw"), c["node"].alias("node")))
        out = out.withColumn(into, F.array_min(drawn)["node"])
    return out.withColumn(into, F.substring_index(into, "/", -1).cast("int"))


def assign(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot, grown_shard (null without ``grown``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        key.alias("_key"),
    )
    placed = descend(rows.withColumn("law", F.lit("key")), tree, "_key", "shard")
    placed = descend(placed, grown, "_key", "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    bucket = F.conv(F.substring(F.md5("_key"), 1, 3), 16, 10).cast("int")
    out = ranked(placed, ["shard"], [id_col, "text_crc32", "size"], bucket, "slot")
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
