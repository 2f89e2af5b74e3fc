"""Signals, images, tensors and graphs out of the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples(sid, idx, v): the values of a user in order of time."""
    order = Window.partitionBy("sid").orderBy("ts", "event_id")  # by the name that is kept, so that later windows need no exchange
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), "ts", "event_id", F.col("value").alias("v"))
    return rows.select("sid", (F.row_number().over(order) - 1).alias("idx"), "v")


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.select(F.col("vec_id").alias("sid"), F.posexplode("embedding").alias("idx", "x")).select("sid", "idx", F.col("x").cast("double").alias("v"))


def embedding_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sid"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


def embedding_pixels(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """pixels(img, r, c, v): vectors of width * width numbers as images."""
    return embedding_samples(spark, sf_dir).select(F.col("sid").alias("img"), F.expr(f"idx div {width}").cast("int").alias("r"), (F.col("idx") % width).alias("c"), "v")


def to_signals(samples: DataFrame) -> DataFrame:
    """signals(sid, samples) from samples(sid, idx, v)."""
    packed = samples.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("p"))
    return packed.select("sid", F.transform("p", lambda x: x["v"]).alias("samples"))


def to_samples(signals: DataFrame) -> DataFrame:
    return signals.select("sid", F.posexplode("samples").alias("idx", "v"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(i, j, w), both directions: lines that customers of one nation ordered from suppliers of another."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = joined.where("a <> b").groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(i, v): a nation's mean account balance in thousands."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    return rows.groupBy(F.col("c_nationkey").alias("i")).agg((F.avg("c_acctbal") / 1000).alias("v"))


def demo_signal(spark: SparkSession, rate: int = 2000, seconds: float = 1.5) -> DataFrame:
    """signals(sid, samples) with one signal: tones of 120 and 280 Hz, noise of a fixed seed, and a step from sample 400 to 429."""
    at = np.arange(int(rate * seconds))
    tones = [(0.7, 120), (0.25, 280)]
    x = sum(level * np.sin(2 * np.pi * hz * at / rate) for level, hz in tones) + 0.08 * np.random.default_rng(42).normal(size=len(at))
    return spark.createDataFrame([("demo", (x + 0.7 * ((at >= 400) & (at < 430))).tolist())], "sid string, samples array<double>")
