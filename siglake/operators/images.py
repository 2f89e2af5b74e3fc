"""Images as pixels(img, r, c, v): layers and morphology by windows over rows, then columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from siglake.errors import odd_window


def image() -> WindowSpec:
    return Window.partitionBy("img")


def gray(red: Column, green: Column, blue: Column) -> Column:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def _extreme(pixels: DataFrame, size: int, pick) -> DataFrame:
    """Separable: along rows, then along columns; a frame cut at the edge is one with edges repeated."""
    half = odd_window(size, "kernel_size") // 2
    along = pixels.select("img", "r", "c", pick("v").over(Window.partitionBy("img", "r").orderBy("c").rowsBetween(-half, half)).alias("v"))
    return along.select("img", "r", "c", pick("v").over(Window.partitionBy("img", "c").orderBy("r").rowsBetween(-half, half)).alias("v"))


def dilate(pixels: DataFrame, size: int = 3) -> DataFrame:
    return _extreme(pixels, size, F.max)


def erode(pixels: DataFrame, size: int = 3) -> DataFrame:
    return _extreme(pixels, size, F.min)


def opening(pixels: DataFrame, size: int = 3) -> DataFrame:
    return dilate(erode(pixels, size), size)


def closing(pixels: DataFrame, size: int = 3) -> DataFrame:
    return erode(dilate(pixels, size), size)


def pair(a: DataFrame, b: DataFrame, value) -> DataFrame:
    other = b.select("img", "r", "c", F.col("v").alias("w"))
    return a.join(other, ["img", "r", "c"]).select("img", "r", "c", value(F.col("v"), F.col("w")).alias("v"))


def gradient(pixels: DataFrame, size: int = 3) -> DataFrame:
    return pair(dilate(pixels, size), erode(pixels, size), lambda a, b: a - b)


def _along(pixels: DataFrame, line: str, at: str, size: int, frame) -> DataFrame:
    """v replaced by frame(v, near, before, after), along the lines of an image: near is a window of `size` pixels, before and after say how often it repeats its line's first and last value."""
    half = odd_window(size, "kernel_size") // 2
    order = Window.partitionBy("img", line).orderBy(at)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, of = F.first("v").over(whole), F.last("v").over(whole), F.count(F.lit(1)).over(whole)
    before = F.greatest(half - F.col(at), F.lit(0)).cast("int")
    after = F.greatest(F.col(at) + half - (of - 1), F.lit(0)).cast("int")
    return pixels.select("img", "r", "c", frame(order.rowsBetween(-half, half), first, last, before, after).alias("v"))


def mean_filter(pixels: DataFrame, size: int = 5) -> DataFrame:
    """Edges repeated. Separable: sums along rows, then along columns."""
    total = lambda near, first, last, before, after: F.sum("v").over(near) + before * first + after * last
    summed = _along(_along(pixels, "r", "c", size, total), "c", "r", size, total)
    return summed.select("img", "r", "c", (F.col("v") / (size * size)).alias("v"))


def median_filter(pixels: DataFrame, size: int = 3) -> DataFrame:
    """Edges repeated: the values near along rows, then those lists along columns."""
    listed = lambda near, first, last, before, after: F.concat(F.array_repeat(first, before), F.collect_list("v").over(near), F.array_repeat(last, after))
    near = _along(_along(pixels, "r", "c", size, listed), "c", "r", size, listed)
    return near.select("img", "r", "c", F.get(F.sort_array(F.flatten("v")), F.lit(size * size // 2)).alias("v"))


def background(pixels: DataFrame, size: int = 15, smooth: int = 5) -> DataFrame:
    return mean_filter(opening(pixels, size), smooth)


def foreground(pixels: DataFrame, ground: DataFrame, mode: str = "dark") -> DataFrame:
    return pair(pixels, ground, (lambda a, b: F.greatest(b - a, F.lit(0.0))) if mode == "dark" else (lambda a, b: F.greatest(a - b, F.lit(0.0))))


def reflections(pixels: DataFrame, percentile: float = 98.0) -> DataFrame:
    return pixels.select("img", "r", "c", F.when(F.col("v") >= F.percentile("v", F.lit(percentile / 100)).over(image()), 1.0).otherwise(0.0).alias("v"))


def shadows_specular(pixels: DataFrame, illumination: DataFrame, strength: float = 0.08, percentile: float = 99.0) -> DataFrame:
    """(img, r, c, shadow, specular) from the ratio of image and illumination."""
    ratio = pair(pixels, illumination, lambda a, b: a / F.greatest(b, F.lit(1e-9)))
    shadow = 1 - F.col("v")
    return ratio.select("img", "r", "c", F.when(shadow >= strength, F.greatest(shadow, F.lit(0.0))).otherwise(0.0).alias("shadow"), F.greatest(F.col("v") - F.percentile("v", F.lit(percentile / 100)).over(image()), F.lit(0.0)).alias("specular"))


def to_bytes(pixels: DataFrame) -> DataFrame:
    low, high = F.min("v").over(image()), F.max("v").over(image())
    return pixels.select("img", "r", "c", F.when(high > low, F.rint(255 * (F.col("v") - low) / (high - low))).otherwise(0.0).cast("int").alias("v"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(img, threshold) over byte values: the first level with the largest variance between both sides."""
    counts = to_bytes(pixels).groupBy("img", F.col("v").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    line, whole = Window.partitionBy("img").orderBy("t").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("img")
    run = counts.select("img", "t", F.sum("n").over(line).alias("w0"), F.sum(F.col("n") * F.col("t")).over(line).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("t")).over(whole).alias("s"))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = run.where("w0 < w").select("img", "t", (F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap).alias("x"))
    best = between.groupBy("img").agg(F.max_by("t", F.struct("x", -F.col("t"))).cast("double").alias("threshold"))
    return counts.select("img").distinct().join(best, "img", "left").select("img", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def ink(ground: DataFrame) -> DataFrame:
    """(img, r, c, ink, stroke) of a foreground, by its Otsu threshold."""
    marked = to_bytes(ground).join(otsu(ground), "img").select("img", "r", "c", F.when(F.col("v") >= F.col("threshold"), 1.0).otherwise(0.0).alias("ink"))
    return ground.join(marked, ["img", "r", "c"]).select("img", "r", "c", "ink", (F.col("v") * F.col("ink")).alias("stroke"))


def alpha(layer: DataFrame) -> DataFrame:
    return layer.select("img", "r", "c", (F.abs(F.col("v")) / F.greatest(F.max(F.abs(F.col("v"))).over(image()), F.lit(1e-9))).alias("v"))


def layers(pixels: DataFrame, background_size: int = 15, smooth: int = 5, illumination_size: int = 31, denoise_size: int = 3, edge_size: int = 3, mode: str = "dark") -> DataFrame:
    """(img, r, c, one column a layer): the whole decomposition."""
    at = ["img", "r", "c"]
    ground = background(pixels, background_size, smooth)
    light = mean_filter(pixels, illumination_size)
    front = foreground(pixels, ground, mode)
    name = lambda df, n: df.select(*at, F.col("v").alias(n))
    out = name(pixels, "gray")
    for df in (name(ground, "background"), name(light, "illumination"), name(front, "raw_foreground"), name(reflections(pixels), "reflections"), shadows_specular(pixels, light), ink(front), name(median_filter(pixels, denoise_size), "denoised"), name(gradient(pixels, edge_size), "edges")):
        out = out.join(df, at)
    return out.withColumn("foreground", F.col("raw_foreground") * (1 - F.col("reflections")) * F.greatest("ink", F.lit(1e-9))).withColumn("noise", F.col("gray") - F.col("denoised")).withColumn("texture", F.col("gray") - F.col("background"))


def reconstruct(out: DataFrame, sign: float = -1.0) -> DataFrame:
    return out.select("img", "r", "c", (F.col("background") + sign * F.col("foreground") + F.col("reflections") + F.col("noise")).alias("v"))
