"""Sparse graph operators: edges(i, j, w) in both directions and nodes(i, v) or nodes(i, ch, v), by joins and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def activate(x: Column, kind: str) -> Column:
    if kind == "relu":
        return F.greatest(x, F.lit(0.0))
    if kind == "tanh":
        return F.tanh(x)
    if kind == "gelu":
        return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))
    return x


def laplacian(nodes: DataFrame, edges: DataFrame, normalized: bool = True) -> DataFrame:
    """(i, j, w) of D - A, or of its normalised form; nodes without edges have 0 on the diagonal."""
    degree = edges.groupBy("i").agg(F.sum("w").alias("d"))
    of = nodes.select("i").distinct().join(degree, "i", "left").select("i", F.coalesce("d", F.lit(0.0)).alias("d"))
    if not normalized:
        return of.select("i", F.col("i").alias("j"), F.col("d").alias("w")).unionByName(edges.select("i", "j", (-F.col("w")).alias("w")))
    other = of.select(F.col("i").alias("j"), F.col("d").alias("dj"))
    off = edges.join(of, "i").join(other, "j").select("i", "j", (-F.col("w") / F.sqrt(F.greatest("d", F.lit(1e-12)) * F.greatest("dj", F.lit(1e-12)))).alias("w"))
    return of.select("i", F.col("i").alias("j"), F.when(F.col("d") > 0, 1.0).otherwise(0.0).alias("w")).unionByName(off)


def multiply(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """Matrix times signal (any channels), as a join and a sum."""
    keys = [c for c in nodes.columns if c not in ("i", "v")]
    x = nodes.select(F.col("i").alias("j"), *keys, "v")
    return matrix.join(x, "j").groupBy("i", *keys).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def polynomial_filter(nodes: DataFrame, edges: DataFrame, coefficients: list[float], normalized: bool = True, activation: str = "linear") -> DataFrame:
    """Sum of c_k L^k x: one sparse product a power."""
    matrix = laplacian(nodes, edges, normalized)
    keys = [c for c in nodes.columns if c != "v"]
    power, total = nodes, nodes.select(*keys, (F.col("v") * coefficients[0]).alias("v"))
    for c in coefficients[1:]:
        power = multiply(matrix, power)
        total = total.unionByName(power.select(*keys, (F.col("v") * c).alias("v")))
    return total.groupBy(*keys).agg(activate(F.sum("v"), activation).alias("v"))


def attention(nodes: DataFrame, edges: DataFrame, alpha: float = 1.0, self_loops: bool = True) -> DataFrame:
    """(i, j, w): softmax over neighbours of alpha x_i x_j; a node with none attends to itself."""
    pairs = edges.where("w > 0").select("i", "j")
    own = nodes.select("i", F.col("i").alias("j"))
    pairs = pairs.union(own).distinct() if self_loops else pairs.union(own.join(pairs.select("i").distinct(), "i", "left_anti"))
    x, y = nodes.select("i", F.col("v").alias("x")), nodes.select(F.col("i").alias("j"), F.col("v").alias("y"))
    scored = pairs.join(x, "i").join(y, "j").withColumn("s", alpha * F.col("x") * F.col("y"))
    row = Window.partitionBy("i")
    e = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(row)))
    return e.select("i", "j", (F.col("e") / F.sum("e").over(row)).alias("w"))


def attention_filter(nodes: DataFrame, edges: DataFrame, alpha: float = 1.0, self_loops: bool = True, activation: str = "linear") -> DataFrame:
    return multiply(attention(nodes, edges, alpha, self_loops), nodes).select("i", activate(F.col("v"), activation).alias("v"))


def message_passing(nodes: DataFrame, edges: DataFrame, self_weight: float = 1.0, neighbor_weight: float = 1.0, aggregation: str = "mean", activation: str = "linear", gate: Column | None = None) -> DataFrame:
    """Own value and the mean or sum of gated neighbours."""
    keys = [c for c in nodes.columns if c not in ("i", "v")]
    x = nodes.select(F.col("i").alias("j"), *keys, F.col("v").alias("x"))
    sent = edges.where("w <> 0").join(x, "j").withColumn("m", neighbor_weight * (gate if gate is not None else F.lit(1.0)) * F.col("x"))
    got = sent.groupBy("i", *keys).agg((F.avg("m") if aggregation == "mean" else F.sum("m")).alias("m"))
    return nodes.join(got, ["i", *keys], "left").select("i", *keys, activate(self_weight * F.col("v") + F.coalesce("m", F.lit(0.0)), activation).alias("v"))


def block_normalize(nodes: DataFrame, mode: str = "layernorm", gamma: float = 1.0, beta: float = 0.0, eps: float = 1e-5) -> DataFrame:
    """Over all nodes of a one-channel signal; with channels, per node (l2, layernorm) or per channel (batchnorm, zscore)."""
    if mode == "none":
        return nodes
    by = [] if "ch" not in nodes.columns else ["i"] if mode in ("l2", "layernorm") else ["ch"]
    keys = [c for c in nodes.columns if c != "v"]
    length = [F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_spread"), F.lit(0.0).alias("_middle")]
    sizes = nodes.groupBy(*by).agg(*(length if mode == "l2" else [F.stddev_pop("v").alias("_spread"), F.avg("v").alias("_middle")]))
    both = nodes.join(sizes, by) if by else nodes.crossJoin(F.broadcast(sizes))  # without keys, sizes is one row
    return both.select(*keys, ((F.col("v") - F.col("_middle")) / F.greatest("_spread", F.lit(eps)) * gamma + beta).alias("v"))


def pool(nodes: DataFrame, factor: int = 2, mode: str = "mean") -> DataFrame:
    return nodes.groupBy(F.floor(F.col("i") / factor).cast("int").alias("i")).agg((F.avg("v") if mode == "mean" else F.max("v")).alias("v"))


def random_walk_encoding(nodes: DataFrame, edges: DataFrame, steps: int = 4) -> DataFrame:
    """(i, step, v): the chance to be back after 1 to steps steps."""
    walk = edges.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("i"))).select("i", "j", F.col("p").alias("w"))
    power, out = walk, None
    for k in range(1, steps + 1):
        if k > 1:
            step = walk.select(F.col("i").alias("j"), F.col("j").alias("to"), F.col("w").alias("q"))
            power = power.join(step, "j").groupBy("i", "to").agg(F.sum(F.col("w") * F.col("q")).alias("w")).withColumnRenamed("to", "j")
        back = power.where("i = j").select("i", F.lit(k).alias("step"), F.col("w").alias("v"))
        out = back if out is None else out.unionByName(back)
    grid = nodes.select("i").distinct().select("i", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return grid.join(out, ["i", "step"], "left").select("i", "step", F.coalesce("v", F.lit(0.0)).alias("v"))
