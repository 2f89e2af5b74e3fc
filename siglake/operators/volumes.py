"""Volumes as voxels(img, z, r, c, v): morphology by three windows.

Medians and any structuring element are found a volume at a time, in Arrow batches. They also take volumes(img, shape, v)
with an array for each volume, row by row; these go through no exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglake.errors import SignalValueError, odd_window

AXES = ("z", "r", "c")
#: Values looked at together.
_CELLS = 1 << 20
#: From values near voxels, the last axis their neighbours, and which of these are there (None: all), to a value and whether there is one.
Pick = Callable[[np.ndarray, np.ndarray | None], tuple]


def _extreme(voxels: DataFrame, size: int, pick) -> DataFrame:
    half = odd_window(size, "kernel_size") // 2
    out = voxels
    for axis in AXES:
        line = Window.partitionBy("img", *[a for a in AXES if a != axis]).orderBy(axis).rowsBetween(-half, half)
        out = out.select("img", *AXES, pick("v").over(line).alias("v"))
    return out


def dilate(voxels: DataFrame, size: int = 3) -> DataFrame:
    return _extreme(voxels, size, F.max)


def erode(voxels: DataFrame, size: int = 3) -> DataFrame:
    return _extreme(voxels, size, F.min)


def opening(voxels: DataFrame, size: int = 3) -> DataFrame:
    return dilate(erode(voxels, size), size)


def closing(voxels: DataFrame, size: int = 3) -> DataFrame:
    return erode(dilate(voxels, size), size)


def gradient(voxels: DataFrame, size: int = 3) -> DataFrame:
    low = erode(voxels, size).withColumnRenamed("v", "w")
    return dilate(voxels, size).join(low, ["img", *AXES]).select("img", *AXES, (F.col("v") - F.col("w")).alias("v"))


def offsets_of(kernel) -> list[tuple[int, int, int]]:
    """Cells above zero of a nested list, counted from its centre."""
    size = (len(kernel), len(kernel[0]), len(kernel[0][0]))
    return [(z - size[0] // 2, r - size[1] // 2, c - size[2] // 2) for z in range(size[0]) for r in range(size[1]) for c in range(size[2]) if kernel[z][r][c] > 0]


def _rounds(volumes: DataFrame, rounds: list[tuple[list[tuple[int, int, int]], Pick]]) -> DataFrame:
    """voxels of volumes after rounds of a pick over offsets, edges repeated. Whole volumes stay in their rows; only voxels are brought together first, by one exchange."""
    if not all(offsets for offsets, _ in rounds):
        raise SignalValueError("a structuring element needs a cell")
    whole = "shape" in volumes.columns
    packed = volumes.select("img", "shape", F.col("v").cast("array<double>").alias("v")).where("v is not null") if whole else _packed(volumes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for same in _alike(batch):
                yield _filtered(batch.slice(at, same), rounds)
                at += same

    done = packed.mapInArrow(run, packed.schema)
    if not whole:
        return done.select("img", F.explode(F.arrays_zip(*AXES, "v")).alias("x")).select("img", *[f"x.{a}" for a in AXES], "x.v")
    wide, deep = F.get("shape", 1), F.get("shape", 2)
    z, r = F.floor(F.col("k") / (wide * deep)), F.floor(F.col("k") / deep) % wide
    return done.select("img", "shape", F.posexplode("v").alias("k", "v")).select("img", z.cast("int").alias("z"), r.cast("int").alias("r"), (F.col("k") % deep).cast("int").alias("c"), "v")


def _packed(voxels: DataFrame) -> DataFrame:
    """(img, z, r, c, v) with arrays, a volume a row."""
    cells = voxels.groupBy("img").agg(F.collect_list(F.struct(*[F.col(a).cast("int").alias(a) for a in AXES], F.col("v").cast("double").alias("v"))).alias("x"))
    return cells.select("img", *[F.col(f"x.{a}").alias(a) for a in (*AXES, "v")])


def _places(batch: pa.RecordBatch, i: int) -> tuple:
    """What says where the voxels of row i are."""
    if "shape" in batch.schema.names:
        return (*batch["shape"][i].as_py(), len(batch["v"][i]))
    return tuple(np.asarray(batch[a][i].values).tobytes() for a in AXES)


def _alike(batch: pa.RecordBatch) -> Iterator[int]:
    """How many rows, one after the other, have their voxels in the same places."""
    n, last = 0, None
    for i in range(batch.num_rows):
        here = _places(batch, i)
        if n and (here != last or n * len(batch["v"][i]) >= _CELLS):
            yield n
            n = 0
        n, last = n + 1, here
    if n:
        yield n


def _filtered(rows: pa.RecordBatch, rounds) -> pa.RecordBatch:
    """Rows with voxels in the same places, v replaced."""
    if "shape" in rows.schema.names:
        *shape, cells = _places(rows, 0)
        at = np.stack(np.unravel_index(np.arange(cells), shape), axis=1) if cells else np.zeros((0, 3), dtype=int)
    else:
        at = np.stack([np.asarray(rows[a][0].values, dtype=np.int64) for a in AXES], axis=1)
    flat = rows["v"].flatten()
    values = np.asarray(flat.fill_null(0.0)).reshape(rows.num_rows, len(at))
    known = np.asarray(flat.is_valid()).reshape(values.shape) if flat.null_count else None
    for offsets, pick in rounds:
        values, known = _round(at, values, known, offsets, pick)
    new = pa.array(values.reshape(-1), mask=None if known is None else ~known.reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * len(at)), new)
    return rows.set_column(rows.schema.get_field_index("v"), "v", lists)


def _round(at: np.ndarray, values: np.ndarray, known: np.ndarray | None, offsets, pick: Pick) -> tuple[np.ndarray, np.ndarray | None]:
    """One pick for every voxel of values(volume, voxel), some voxels at a time."""
    if not len(at):
        return values, known
    least, most = np.minimum(at.min(axis=0), 0), at.max(axis=0)
    size = np.maximum(most, 0) - least + 1
    code = lambda x: ((x[..., 0] - least[0]) * size[1] + x[..., 1] - least[1]) * size[2] + x[..., 2] - least[2]
    order = np.argsort(code(at), kind="stable")
    listed = code(at)[order]
    out, ok = np.empty_like(values), np.ones(values.shape, dtype=bool)
    block = max(1, _CELLS // (len(values) * len(offsets)))
    for start in range(0, len(at), block):
        part = slice(start, start + block)
        wanted = code(np.minimum(np.maximum(at[part][:, None] + np.array(offsets), 0), most))
        found = np.minimum(np.searchsorted(listed, wanted), len(listed) - 1)
        there, near = listed[found] == wanted, order[found]
        if known is not None:
            there = there & known[:, near]
        out[:, part], ok[:, part] = pick(values[:, near], None if there.all() else np.broadcast_to(there, (len(values), *near.shape)))
    return out, None if ok.all() else ok


def _middle(near: np.ndarray, there: np.ndarray | None):
    """The median, between the middle two of an even number; not a number is the largest."""
    k = near.shape[-1]
    if there is None and k % 2:
        return np.partition(near, k // 2, axis=-1)[..., k // 2], True
    n = np.full(near.shape[:-1], k) if there is None else there.sum(axis=-1)
    lined = np.sort(near if there is None else np.where(there, near, np.nan), axis=-1)
    low, high = (np.take_along_axis(lined, np.maximum(i, 0)[..., None], axis=-1)[..., 0] for i in ((n - 1) // 2, n // 2))
    return np.where(low == high, low, 0.5 * low + 0.5 * high), n > 0


def _largest(near: np.ndarray, there: np.ndarray | None):
    return (near if there is None else np.where(there, near, -np.inf)).max(axis=-1), True if there is None else there.any(axis=-1)


def _least(near: np.ndarray, there: np.ndarray | None):
    return np.fmin.reduce(near if there is None else np.where(there, near, np.nan), axis=-1), True if there is None else there.any(axis=-1)


def median(volumes: DataFrame, size: int = 3) -> DataFrame:
    h = odd_window(size, "kernel_size") // 2
    cube = [(z, r, c) for z in range(-h, h + 1) for r in range(-h, h + 1) for c in range(-h, h + 1)]
    return _rounds(volumes, [(cube, _middle)])


def dilate_kernel(volumes: DataFrame, kernel) -> DataFrame:
    return _rounds(volumes, [(offsets_of(kernel), _largest)])


def erode_kernel(volumes: DataFrame, kernel) -> DataFrame:
    return _rounds(volumes, [(offsets_of(kernel), _least)])


def opening_kernel(volumes: DataFrame, kernel) -> DataFrame:
    return _rounds(volumes, [(offsets_of(kernel), _least), (offsets_of(kernel), _largest)])


def closing_kernel(volumes: DataFrame, kernel) -> DataFrame:
    return _rounds(volumes, [(offsets_of(kernel), _largest), (offsets_of(kernel), _least)])
