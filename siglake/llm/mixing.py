"""Mixing sources to target weights by systematic sampling.

Sources stand in code point order, null last, and weigh 1, 2, 3, repeating. Their targets
share all words by weight; a target stops at `most` times its source's words and what is
over goes to the rest by weight. That is one level L with target = min(L * weight, cap),
found in closed form over the sources sorted by cap / weight.

Each document expects target / source words copies. With the documents of a source in a
fixed order, the expected copies are prefix-summed, one offset drawn from the seed and
the source is added, and a document is emitted once for each integer that its interval
crosses. Half of the documents, by a hash of the id, stand in ascending and the other half
after them in descending order of size: neighbours are of one size and both ends are small,
so the words taken miss the target by no more than about the largest document. Sums are in
units of 2^-40 copies, in decimals: reruns agree.

The order is global: rows are dealt by range of (source, size, id), so that a hot source
covers many partitions, then written; a row's place is its place in the partition plus what
lies before that partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglake.llm.common import hashable, pack, partitions_for, quoted, text_bytes, unpack, word_count, written

UNIT = 1 << 40
#: Beyond so many (partition, source) cells their offsets are joined by a shuffle.
BROADCAST_CELLS = 100_000


def source_targets(sizes: DataFrame, most: float = 3.0, period: int = 3) -> DataFrame:
    """sizes(source, source_size) to source, source_size, target.

    One row a source, the null source among them; the windows are over sources, sizes alone. Equal
    ratios stand in order of the source. Without sources the result is empty; sources without
    words have target 0.
    """
    ranked = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % period + 1).cast("double"))
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = capped.withColumn("level", left).withColumn("place", F.row_number().over(order))
    level = F.coalesce(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(whole)["level"], F.max("ratio").over(whole))
    return levels.withColumn("found", level).select("source", "source_size", F.least(F.col("found") * F.col("weight"), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, seed: int = 17, expand: bool = False) -> DataFrame:
    """docs with size (words), source_size, target and copies; with expand, each row copies times instead.

    Nulls: a null source is a source, the last in order; a null text has size 0; null ids come
    first in the order. Documents without words carry no weight but are sampled like others.
    Repeated rows are sampled one by one. An empty table gives an empty result. Input columns
    named like an output column give way to it.
    """
    spark = docs.sparkSession
    thin = pack(
        docs, F.col(quoted(source)).cast("string").alias("source"), F.col(quoted(key)).alias("k"), word_count(F.col(quoted(text))).alias("size"),
        text_bytes(F.col(quoted(text))).alias("bytes"), F.xxhash64(*hashable(docs)).alias("h"), F.monotonically_increasing_id().alias("place"),
    )
    sums = written(thin.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "sources")
    seen = sums.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    parts = partitions_for(spark, seen[0] or 0)
    falls = F.coalesce(F.substring(F.md5(F.col("k").cast("string")), 1, 1) >= "8", F.lit(False))
    order = [F.col("source").asc_nulls_last(), falls, F.when(falls, -F.col("size")).otherwise(F.col("size")), "k", "h", "place"]
    lined = thin.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("row", "source", "size", F.monotonically_increasing_id().alias("at"))
    lined = written(lined, "lined").select("row", "source", "size", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))

    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = lined.groupBy("source", "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("source", "part", "offset")
    share = source_targets(sums.select("source", "source_size"), most)
    tag = F.concat(F.lit(f"{seed}|"), F.when(F.col("source").isNull(), "n|").otherwise(F.concat(F.lit("s|"), F.col("source"))))
    share = share.select(
        "source", "source_size", "target",
        F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * UNIT), F.lit(0)).alias("rate"),
        (F.conv(F.substring(F.md5(tag), 1, 8), 16, 10).cast("long") * F.lit(UNIT >> 32)).alias("start"),
    )
    plan = cells.alias("c").join(share.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "part", "offset", "source_size", "target", "rate", "start")
    if parts + seen[1] <= BROADCAST_CELLS:
        plan = F.broadcast(plan)
    joined = lined.alias("d").join(plan.alias("p"), (F.col("d.part") == F.col("p.part")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    edge = lambda rank: f"((cast({rank} as decimal(20,0)) * cast(rate as decimal(16,0)) + start) div {UNIT})"
    out = joined.select("row", "size", "source_size", "target", F.expr(f"{edge('pos + offset + 1')} - {edge('pos + offset')}").cast("long").alias("copies"))
    if not expand:
        return unpack(out, ["size", "source_size", "target", "copies"])
    return unpack(out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), [])
