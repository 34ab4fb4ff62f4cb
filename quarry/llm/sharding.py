"""Sharding by best-fit-decreasing bin packing (operator 10).

Documents of equal text are one group that no shard boundary splits. Groups in
descending size each enter the bin whose remaining capacity is the tightest
that still holds them; remaining capacities stand in a balanced search tree, so
a placement takes logarithmic time. ``pack`` opens bins of a fixed capacity as
needed and so keeps their number small; ``pack_into`` looks for the smallest
capacity with which at most ``n`` bins suffice.

The driver never sees all groups: packing has two levels, and every group goes
through the tree at the first. Groups are dealt to cells by a hash, about
``PER_CELL`` groups each, and each cell's are packed, in descending size, into
items of 1 / ``GRAIN`` of all bytes; a group above that is an item of its own. The
items of all cells are then packed into the shards. Any two items of a cell
exceed an item's capacity together, so there are fewer than 2 * ``GRAIN`` items,
one more per cell, and at most ``GRAIN`` large groups: what the driver packs and
broadcasts is bounded by constants at any size. The price of the second level is
at most an item's bytes in a shard's fill, 1 / 256 of a shard with 16 shards.
With ``capacity`` in place of a number of shards, items are 1 / ``PIECES`` of it,
and as few shards are opened as packing needs; the driver then packs about 2 * ``PIECES``
items per shard, and their table is broadcast only where it is small.

Rows find their shard by a join on the group. Groups of at least 1 / ``HOT`` of
all rows, of which there are at most ``HOT``, go through a broadcast, so no
shuffled key holds more than that share. Slots are numbered per shard from counts
of (shard, cell) parts, so a group of copies that holds a third of the rows is
spread over many tasks.

Defined cases: a null text is of size 1 and a group of its own, apart from the
empty text, which is of size 1 too; a null or repeated doc_id changes nothing, as
groups are texts; repeated rows are members of their group like any others; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import releasing, written

SHARDS, GRAIN, PIECES, PER_CELL, CELLS, HOT = 16, 4096, 64, 20_000, 4096, 1024
#: Rows of a shard that are numbered together, and items that a cell can number.
ROWS_PER_PART, ITEMS = 50_000, 1 << 40


class BalancedTree:
    """An AA tree of distinct (capacity, bin) pairs with the least pair that is not below a key."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # nodes are [key, level, left, right]

    @staticmethod
    def _level(n) -> int:
        return n[1] if n else 0

    @classmethod
    def _skew(cls, n):
        if n and n[2] and n[2][1] == n[1]:
            left = n[2]
            n[2], left[3] = left[3], n
            return left
        return n

    @classmethod
    def _split(cls, n):
        if n and n[3] and n[3][3] and n[3][3][1] == n[1]:
            right = n[3]
            n[3], right[2] = right[2], n
            right[1] += 1
            return right
        return n

    def insert(self, key) -> None:
        self.root = self._insert(self.root, key)

    def _insert(self, n, key):
        if n is None:
            return [key, 1, None, None]
        k = 2 if key < n[0] else 3
        n[k] = self._insert(n[k], key)
        return self._split(self._skew(n))

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, n, key):
        if n is None:
            return None
        if key < n[0]:
            n[2] = self._remove(n[2], key)
        elif key > n[0]:
            n[3] = self._remove(n[3], key)
        elif n[2] is None and n[3] is None:
            return None
        elif n[2] is None:
            m = n[3]
            while m[2]:
                m = m[2]
            n[0] = m[0]
            n[3] = self._remove(n[3], m[0])
        else:
            m = n[2]
            while m[3]:
                m = m[3]
            n[0] = m[0]
            n[2] = self._remove(n[2], m[0])
        want = min(self._level(n[2]), self._level(n[3])) + 1
        if want < n[1]:
            n[1] = want
            if n[3] and n[3][1] > want:
                n[3][1] = want
        n = self._skew(n)
        n[3] = self._skew(n[3])
        if n[3]:
            n[3][3] = self._skew(n[3][3])
        n = self._split(n)
        n[3] = self._split(n[3])
        return n

    def ceiling(self, key):
        """The least pair that is not below ``key``, or None."""
        n, found = self.root, None
        while n:
            if n[0] >= key:
                found, n = n[0], n[2]
            else:
                n = n[3]
        return found


def pack(sizes: list[int], capacity: int, limit: int | None = None) -> list[int] | None:
    """The bin of each size, best fit decreasing (ties: earlier size, lower bin); None if more than ``limit`` bins are needed."""
    tree, bins, out = BalancedTree(), 0, [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if sizes[k] > capacity:
            return None
        found = tree.ceiling((sizes[k], -1))
        if found is None:
            if limit is not None and bins == limit:
                return None
            left, at, bins = capacity, bins, bins + 1
        else:
            left, at = found
            tree.remove(found)
        out[k] = at
        tree.insert((left - sizes[k], at))
    return out


def pack_into(sizes: list[int], n: int) -> list[int]:
    """The bins of ``sizes`` under the smallest capacity, found by halving, that needs at most ``n`` bins."""
    if not sizes:
        return []
    low, high = max(max(sizes), -(-sum(sizes) // n)), max(sizes) + -(-sum(sizes) // n)
    best = pack(sizes, high, n)
    while low < high:
        mid = (low + high) // 2
        found = pack(sizes, mid, n)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid
    return best


def items_of(groups: DataFrame, capacity: int) -> DataFrame:
    """(group, item, bytes) of rows (cell, group, bytes): each cell's groups packed best fit decreasing into items of a capacity."""

    def run(batches):
        tree, cell, opened = BalancedTree(), None, 0
        for batch in batches:
            out = []
            for at, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if at != cell:
                    tree, cell, opened = BalancedTree(), at, 0
                found = tree.ceiling((size, -1))
                if found is None:
                    left, item, opened = capacity, opened, opened + 1
                else:
                    left, item = found
                    tree.remove(found)
                if left > size:
                    tree.insert((left - size, item))
                out.append(at * ITEMS + item)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int64()), batch.column(2)], names=["group", "item", "bytes"])

    ordered = groups.select("cell", "group", "bytes").repartition("cell").sortWithinPartitions("cell", F.col("bytes").desc(), "group")
    return ordered.mapInArrow(releasing(run), "group binary, item long, bytes long")


def sharded(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None, grain: int = GRAIN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law ``bytes``.

    There are ``shards`` shards of the smallest capacity that suffices or, with ``capacity``, as few
    of that capacity as packing needs; then a text whose copies exceed it is an error.
    """
    spark = docs.sparkSession
    data = F.col("text").cast("string").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(data, 256)), F.lit(b"")).alias("group"),
    )
    rows = written(rows.withColumn("tie", F.monotonically_increasing_id()), "sharding-rows")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "sharding-groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups"), F.max("bytes").alias("largest")).first()
    if capacity is not None and (total["largest"] or 0) > capacity:
        raise ValueError(f"a text's copies take {total['largest']} bytes, more than a shard's {capacity}")
    item = max(1, -(-(total["bytes"] or 0) // grain)) if capacity is None else max(1, capacity // PIECES)
    cells = min(CELLS, max(1, -(-total["groups"] // PER_CELL)))
    packed = written(items_of(groups.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells))), item), "sharding-items")
    items = sorted(packed.groupBy("item").agg(F.sum("bytes").alias("bytes")).collect(), key=lambda r: r["item"])
    sizes = [r["bytes"] for r in items]
    bins = pack_into(sizes, shards) if capacity is None else pack(sizes, capacity)
    placed = spark.createDataFrame([(r["item"], b) for r, b in zip(items, bins)], "item long, shard int")
    # with a capacity the items grow with the corpus: their table is written, so that Spark goes by its size
    placed = F.broadcast(placed) if capacity is None else written(placed, "sharding-placed")
    assigned = packed.join(placed, "item").select("group", "shard")
    hot = assigned.join(F.broadcast(groups.filter(F.col("rows") * HOT >= (total["rows"] or 0)).select("group")), "group", "left_semi")
    hot = written(hot, "sharding-hot")
    few = rows.join(F.broadcast(hot), "group")
    rest = rows.join(F.broadcast(hot), "group", "left_anti").join(assigned, "group")
    parts = max(1, (total["rows"] or 0) // ((max(bins, default=0) + 1) * ROWS_PER_PART))
    owned = few.unionByName(rest).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("tie"), F.lit(parts)).alias("part"), "tie")
    return slotted(written(owned, "sharding-owned"))


def slotted(owned: DataFrame) -> DataFrame:
    """Slots per shard: the parts before a row's own, then its place within the part, by the order in which rows are stored."""
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = owned.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = W.partitionBy("shard", "part").orderBy("tie")
    return (
        owned.join(written(first, "sharding-parts"), ["shard", "part"])
        .withColumn("slot", (F.col("first") + F.row_number().over(place) - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )
