"""Operator 4: best-fit-decreasing packing of indivisible groups into shards.

``best_fit_decreasing`` is the packing itself: groups in descending size each enter the
bin with the tightest sufficient remaining capacity, found in a balanced search tree of
remaining capacities; a new bin is opened when none fits, or the emptiest bin is
overfilled once ``max_bins`` are open.

``assign_shards`` runs it over a DataFrame. Groups (equal texts) are summed by a hash
aggregation. Only groups of at least ``grain`` bytes are packed one by one; their number
is bounded by total / grain. Smaller groups are first gathered into hash-addressed
bundles whose number is fixed, and a bundle is packed as one item. So the driver sees at
most ``2 * grains`` items whatever the corpus size, and shard sizes differ by about one
item. Law: ``bytes`` (sizes near equal), as far as one indivisible group permits.

Cases: null text has size 8 and joins the group of empty texts; repeated rows each take
a slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import cut, read, shuffle_partitions

N_SHARDS = 24
GRAINS = 1 << 15


class CapacityTree:
    """A treap of (remaining capacity, bin): expected logarithmic insert, removal and best-fit search."""

    def __init__(self) -> None:
        self._root = None
        self._rng = random.Random(7)

    @staticmethod
    def _split(node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = CapacityTree._split(node[3], key)
            node[3] = left
            return node, right
        left, right = CapacityTree._split(node[2], key)
        node[2] = right
        return left, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = CapacityTree._merge(a[3], b)
            return a
        b[2] = CapacityTree._merge(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, [key, self._rng.random(), None, None]), right)

    def remove(self, key: tuple[int, int]) -> None:
        left, rest = self._split(self._root, key)
        _, right = self._split(rest, (key[0], key[1] + 1))
        self._root = self._merge(left, right)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """The smallest remaining capacity that is at least ``need``."""
        node, best = self._root, None
        while node is not None:
            if node[0][0] >= need:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def largest(self) -> tuple[int, int] | None:
        node = self._root
        while node is not None and node[3] is not None:
            node = node[3]
        return node and node[0]


def best_fit_decreasing(items: list[tuple[object, int]], capacity: int, max_bins: int | None = None) -> dict[object, int]:
    """Bin of each (key, size). Without ``max_bins`` the number of bins of ``capacity`` is kept small."""
    tree, bins, out = CapacityTree(), 0, {}
    for key, size in sorted(items, key=lambda x: (-x[1], str(x[0]))):
        at = tree.tightest(size)
        if at is None and (max_bins is None or bins < max_bins):
            at = (capacity, bins)
            bins += 1
        elif at is None:
            at = tree.largest()
            tree.remove(at)
        else:
            tree.remove(at)
        tree.add((at[0] - size, at[1]))
        out[key] = at[1]
    return out


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, grains: int = GRAINS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns id, size, text_crc32, shard, slot. Slots count up from 0 without gaps within a shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("g1"),
        F.xxhash64(F.lit("group"), F.octet_length(body), body).alias("g2"),
    )
    total = rows.agg(F.sum("size").alias("t")).first()["t"] or 0
    grain = max(1, total // (n_shards * 64), total // grains)
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    item = F.when(F.col("bytes") >= grain, F.struct(F.col("g1").alias("a"), F.col("g2").alias("b"), F.lit(True).alias("big"))).otherwise(
        F.struct(F.pmod("g1", F.lit(grains)).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(False).alias("big"))
    )
    groups = cut(groups.select("g1", "g2", "bytes", item.alias("item")))
    items = [((r["item"]["a"], r["item"]["b"], r["item"]["big"]), r["bytes"]) for r in groups.groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()]
    placed = best_fit_decreasing(items, -(-total // n_shards), n_shards)
    plan = spark.createDataFrame([(a, b, big, s) for (a, b, big), s in placed.items()], "a long, b long, big boolean, shard int")
    big = groups.filter("item.big").join(F.broadcast(plan.filter("big").select("a", "b", F.col("shard").alias("big_shard"))), (F.col("g1") == F.col("a")) & (F.col("g2") == F.col("b")))
    big = big.select("g1", "g2", "big_shard")  # at most `grains` rows
    small = plan.filter("not big").select(F.col("a").alias("bundle"), F.col("shard").alias("small_shard"))
    placed_rows = (
        rows.join(F.broadcast(big), ["g1", "g2"], "left")
        .withColumn("bundle", F.pmod("g1", F.lit(grains)))
        .join(F.broadcast(small), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("big_shard", "small_shard").alias("shard"))
    )
    parts = max(1, shuffle_partitions(spark))
    placed_rows = placed_rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    counts = placed_rows.groupBy("shard", "part").count()  # n_shards * parts rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed_rows.withColumn("n", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"))
    )


def op4_bfd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
