"""Sharding: two-pass external shuffle, by DataFrame functions alone.

Pass 1 scatters records with seeded hashes into buckets of bounded bytes, applies a
Fisher-Yates shuffle (Spark's `shuffle` expression) to each bucket and writes the result.
Pass 2 counts the written buckets and turns bucket positions into gapless slots of a shard.

A shard follows from the key and the number of shards alone (highest random weight), so
that one more shard takes rows only into itself. Inside a shard, the bucket of a record
follows from a hash of its whole row and its place in the input table: neither a key that
repeats nor a row that repeats fills a bucket. The input must be a stored table or a plan
over one, so that a task that runs again sees the same places.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglake.llm.common import hashable, pack, partitions_for, quoted, text_bytes, unpack, written

#: Beyond so many buckets their offsets are joined by a shuffle, not broadcast (24 bytes each).
BROADCAST_BUCKETS = 100_000


def shard_documents(docs: DataFrame, shards: int = 16, *, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """docs with shard, grown_shard (with one shard more) and slot (place in the shard, gapless).

    Nulls: a null key is a key like any other, so all such rows share a shard; a null text
    counts one byte. Repeated rows are kept, each with a slot of its own. An empty table gives
    an empty result. Input columns named like an output column give way to it.
    """
    if not 1 <= shards <= 4096:
        raise ValueError("shards must be between 1 and 4096")
    spark = docs.sparkSession
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards)), lambda s: F.struct(F.xxhash64(F.lit(seed), F.col("k"), s).alias("w"), s.alias("s")))
    thin = pack(docs, F.col(quoted(key)).alias("k"), (text_bytes(F.col(quoted(text))) + 1).alias("size"), F.xxhash64(F.lit(seed), *hashable(docs)).alias("h"))
    dealt = (
        thin.withColumn("draws", draws)
        .withColumn("shard", F.array_max(F.slice("draws", 1, shards))["s"])
        .withColumn("grown_shard", F.array_max("draws")["s"])
        .drop("draws", "k")
    )
    bytes_of = {r["shard"]: r["n"] for r in dealt.groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row for each shard
    subs = [max(1, math.ceil(bytes_of.get(s, 0) / bucket_bytes)) for s in range(shards)]
    buckets = sum(subs)
    sub = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("h"), F.monotonically_increasing_id()), F.element_at(F.array(*[F.lit(n) for n in subs]), F.col("shard") + 1).cast("long"))
    parts = partitions_for(spark, sum(bytes_of.values()))
    scattered = dealt.withColumn("sub", sub).repartition(parts, "shard", "sub")
    by_hash = lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)
    shuffled = (
        scattered.groupBy("shard", "sub")
        .agg(F.collect_list(F.struct("h", "grown_shard", "row")).alias("rows"))
        .sortWithinPartitions("shard", "sub")
        .select("shard", "sub", F.posexplode(F.shuffle(F.array_sort("rows", by_hash), F.lit(seed))).alias("pos", "item"))
        .select("shard", "sub", "pos", F.col("item.grown_shard").alias("grown_shard"), F.col("item.row").alias("row"))
    )
    first_pass = written(shuffled, "scattered")
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = first_pass.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    placed = first_pass.join(offsets, ["shard", "sub"]).withColumn("slot", F.col("offset") + F.col("pos"))
    return unpack(placed, ["shard", "grown_shard", "slot"])


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, its rows in files by ranges of slots, each in the order of its slots.

    Names other than shard and slot don't matter; repeated rows are written each; an empty table
    writes no shard.
    """
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
