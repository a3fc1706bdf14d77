"""Sharding by a hierarchical weighted hash tree.

A key descends from regions to racks to shards. At each level every child draws -ln(u) / weight, with u from a hash of
the key and the child's name, and the smallest draw wins: children get keys by weight, and a child whose weight grows
only gains keys. A change of a shard's weight changes weights on its path alone, so rows move within the subtrees on it
or into them. A shard added as a region of its own takes rows only into itself.

Weights and names are parameters; draws are Catalyst expressions. Slots number the rows of a shard without a gap in the
order of (doc_id, CRC-32, size): the rows are sorted over ranges and each range starts where those before it end, so no
shard meets in one task.

Defined results: a null key is a key of its own (the word null). Null text has size 1 and the CRC-32 of no bytes. Rows that repeat a key
share its shard and have a slot each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stored, whole

#: Shards of a rack, and racks of a region, where a plain number of shards is laid out.
RACK, REGION = 2, 2


@dataclass
class Node:
    name: str
    weight: float = 0.0
    children: list[Node] = field(default_factory=list)
    shard: int | None = None

    def __post_init__(self):
        if self.children:
            self.weight = sum(c.weight for c in self.children)


def layout(shards: int) -> Node:
    """Regions of full racks of equal shards; each of the shards that remain is a region of its own."""
    full = shards // (RACK * REGION)
    leaf = lambda s: Node(f"shard{s}", 1.0, shard=s)
    regions = [Node(f"region{g}", children=[Node(f"rack{g}.{r}", children=[leaf((g * REGION + r) * RACK + i) for i in range(RACK)]) for r in range(REGION)]) for g in range(full)]
    rest = [Node(f"own{s}", children=[Node(f"ownrack{s}", children=[leaf(s)])]) for s in range(full * RACK * REGION, shards)]
    return Node("root", children=regions + rest)


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard, as a region of its own: no other weight changes, so rows move into it only."""
    return Node(tree.name, children=[*tree.children, Node(f"own{shard}", children=[Node(f"ownrack{shard}", children=[Node(f"shard{shard}", weight, shard=shard)])])])


def draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u from the first 48 bits of the MD5 of the key and the child's name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}")).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 1.0) / F.lit(float(2**48 + 1))) / F.lit(float(weight))


def descend(key: Column, node: Node) -> Column:
    """The shard of a key below a node."""
    children = [c for c in node.children if c.weight > 0]
    if not node.children:
        return F.lit(node.shard)
    below = [descend(key, c) for c in children]
    if len(children) == 1:
        return below[0]
    winner = F.array_min(F.array(*[F.struct(draw(key, c.name, c.weight).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(children)]))["child"]
    out = F.when(winner == 0, below[0])
    for i, b in enumerate(below[1:-1], 1):
        out = out.when(winner == i, b)
    return out.otherwise(below[-1])


def key_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("null"))


def shard_documents(documents: DataFrame, tree: Node, more: Node) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard): where each row is in the tree, and where it would be in the other."""
    spark = prepare(documents.sparkSession)
    text = F.col("text").cast("string").cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    key = key_text(F.col("doc_id"))
    rows = rows.withColumns({"shard": descend(key, tree).cast("int"), "grown_shard": descend(key, more).cast("int")})
    # The last sort key parts rows that are alike, so that a key with a third of all rows spreads over ranges.
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    order = ["shard", "doc_id", "text_crc32", "size", "salt"]
    narrow = stored(rows, "sharded")  # the ranges' sample and their shuffle then don't draw again
    rows = whole(narrow.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("salt"))
    discard(narrow)
    placed = rows.withColumn("row", F.monotonically_increasing_id())
    part, place = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    held = placed.groupBy(part.cast("int").alias("part"), "shard").count().collect()  # a row for each range and shard in it
    sizes: dict[int, int] = {}
    shards: dict[int, int] = {}
    for r in held:
        sizes[r["part"]] = sizes.get(r["part"], 0) + r["count"]
        shards[r["shard"]] = shards.get(r["shard"], 0) + r["count"]
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    begun, total = [], 0
    for s in sorted(shards):
        begun.append((s, total))
        total += shards[s]
    starts = spark.createDataFrame(starts, "part int, ahead long")
    begun = spark.createDataFrame(begun, "shard int, before long")
    placed = placed.withColumn("part", part.cast("int")).join(F.broadcast(starts), "part").join(F.broadcast(begun), "shard")  # as many rows as ranges, and as shards
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + place - F.col("before")).alias("slot"), "grown_shard")
