"""Medians and shaped kernels of volumes beside brute force."""

import math
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglake import catalog
from siglake.operators import volumes

CROSS = [[[0, 0, 0], [0, 1, 0], [0, 0, 0]], [[0, 1, 0], [1, 1, 1], [0, 1, 0]], [[0, 0, 0], [0, 1, 0], [0, 0, 0]]]
CUBE = [(z, r, c) for z in (-1, 0, 1) for r in (-1, 0, 1) for c in (-1, 0, 1)]


def by_hand(cells, offsets, pick):
    """cells {(z, r, c): v}: neighbours with edges repeated; what isn't there, or is null, is left out."""
    ends = [max(p[a] for p in cells) for a in range(3)]
    near = {p: [cells[q] for o in offsets if cells.get(q := tuple(min(max(x + d, 0), e) for x, d, e in zip(p, o, ends, strict=True))) is not None] for p in cells}
    return {p: pick(v) if v else None for p, v in near.items()}


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(7)
    out = {}
    for i, shape in enumerate([(4, 4, 4), (4, 4, 4), (2, 3, 5), (1, 1, 1), (4, 4, 4)]):
        out[i] = {p: float(x) for p, x in zip(np.ndindex(*shape), rng.normal(size=math.prod(shape)), strict=True)}
    out[1] |= {(0, 0, 0): None, (2, 1, 3): None}
    out[4] = {p: v for p, v in out[4].items() if sum(p) % 3}  # some aren't there
    return out


def same(frame, want):
    got = {(r["img"], r["z"], r["r"], r["c"]): r["v"] for r in frame.collect()}
    flat = {(i, *p): v for i, cells in want.items() for p, v in cells.items()}
    assert set(got) == set(flat)
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-12) for k, v in flat.items())


CASES = {
    "median": (lambda v: volumes.median(v), lambda x: by_hand(x, CUBE, median)),
    "opening": (lambda v: volumes.opening_kernel(v, CROSS), lambda x: by_hand(by_hand(x, volumes.offsets_of(CROSS), min), volumes.offsets_of(CROSS), max)),
    "closing": (lambda v: volumes.closing_kernel(v, CROSS), lambda x: by_hand(by_hand(x, volumes.offsets_of(CROSS), max), volumes.offsets_of(CROSS), min)),
}


@pytest.mark.parametrize("name", list(CASES))
def test_voxels_beside_brute_force(spark, made, name):
    frame = spark.createDataFrame([(i, *p, v) for i, cells in made.items() for p, v in cells.items()], "img long, z int, r int, c int, v double")
    same(CASES[name][0](frame), {i: CASES[name][1](cells) for i, cells in made.items()})


@pytest.mark.parametrize("name", list(CASES))
def test_whole_volumes_beside_brute_force(spark, made, name):
    whole = {i: made[i] for i in (0, 1, 2, 3)}
    rows = [(i, [max(p[a] for p in cells) + 1 for a in range(3)], list(cells.values())) for i, cells in whole.items()]
    frame = spark.createDataFrame([*rows, (9, [4, 4, 4], None)], "img long, shape array<int>, v array<double>")
    same(CASES[name][0](frame), {i: CASES[name][1](cells) for i, cells in whole.items()})


@pytest.mark.parametrize("name", ["volume_median", "volume_kernel_opening"])
def test_whole_volumes_go_through_no_exchange(spark, name):
    frame = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert frame.count() == 64 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where(F.size("embedding") == 64).count()
