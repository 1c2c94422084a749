"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass 1 gives every record a seeded hash of its content and scatters the records' handles by it, uniformly, over buckets of a
size that fits in memory. Pass 2 permutes each bucket (``shuffle`` is an inside-out Fisher-Yates) in a task of its own and
numbers all records through. Consecutive stretches of that one permutation are the shards, so their row
counts are at most one apart (the law ``rows``). Texts move once, to the place that their handle has got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitspark.llm._io import table
from pitspark.llm._rows import occurrences

#: Bytes that a record counts besides its text.
RECORD_BYTES = 16
#: Handles of a bucket; one has about 50 bytes in memory.
BUCKET_ROWS = 250_000


def shuffle_into_shards(docs: DataFrame, *, shards: int = 40, seed: int = 7, text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` and ``size`` (UTF-8 bytes of the text plus 16), ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each
    shard), in a random order that follows from the seed and the rows alone: however files and partitions
    hold them, the same rows get the same places (equal rows in either order).

    A null text has size 16; texts of any length count one handle; with fewer rows than shards some shards stay
    empty; an empty table gives none. Input columns named size, shard or slot are replaced; others may have any name;
    columns of maps are not part of the hash. Records come from a table that is written once, buckets are sorted before
    they are permuted, and each is a partition with a seed of its own, so a task that runs again gives the same result."""
    rows = docs.drop("size", "shard", "slot")
    size = (F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)) + RECORD_BYTES).cast("long")
    content = F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()))
    staged = table(rows.select(F.struct("*").alias("record"), size.alias("size"), F.monotonically_increasing_id().alias("place"), content.alias("h")), "shards")
    n = staged.count()
    buckets = max(1, -(-n // bucket_rows))
    handles = occurrences(staged.select("place", "h")).withColumn("g", F.xxhash64(F.lit(seed), "h", "copy"))
    scattered = handles.withColumn("bucket", F.pmod("g", F.lit(buckets)).cast("int"))

    # one row per bucket: where it begins in the whole permutation
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / 4096))
    # sums over blocks of buckets first, so that no task sees all buckets
    within = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = counts.join(blocks, "block").select("bucket", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("start"))

    # partition i is bucket i, and draws from a sequence seeded by it
    permuted = (
        scattered.select("bucket", "g", "h", "place").repartitionById(buckets, "bucket").groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("g", "h", "place"))).alias("handles"))
        .select("bucket", F.posexplode(F.shuffle(F.col("handles.place"), F.lit(seed))).alias("i", "place"))
    )
    k = permuted.join(starts, "bucket").select("place", (F.col("start") + F.col("i")).alias("k"))
    total = n or 1
    shard = F.expr(f"cast(k * {shards} div {total} AS int)")
    first = F.expr(f"cast(ceil(cast(shard AS decimal(38,0)) * {total} / {shards}) AS long)")
    placed = k.withColumn("shard", shard).select("place", "shard", (F.col("k") - first).alias("slot"))
    return staged.join(placed, "place").select("record.*", "size", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=N`` per shard; each file holds a stretch of slots in their order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
