"""Packets of many tensors at once beside those of one, and how much is held of a table."""

import numpy as np
import pytest

from siglake.functions import packet_batches, wavelets
from siglake.operators import vectors

POLICIES = ["fixed", "adaptive", "blockwise", "regularized", "multiobjective", "learnable", "spatial", "subband", "attentive", "cross_branch", "level_attentive"]


@pytest.mark.parametrize("taps", [1, 2, 3, 4, 5, 8])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8])
def test_along_is_same_convolution(n, taps):
    rng = np.random.default_rng(n * 10 + taps)
    x, h = rng.normal(size=(2, n, 3)), rng.normal(size=taps)
    want = np.apply_along_axis(lambda v: np.convolve(v, h, "same"), 1, x)
    assert np.allclose(wavelets.along(x, 1, h), want) and np.allclose(wavelets.along(x, 1, h, 2), want[:, ::2])


@pytest.mark.parametrize("level", [1, 2])
@pytest.mark.parametrize("name", POLICIES)
@pytest.mark.parametrize("shape,names", [((2, 2, 4), ["haar", "db2"]), ((4, 4), ["haar", "db2", "cdf53"])])
def test_many_tensors_beside_each_one(name, level, shape, names):
    if level == 2 and name in ("cross_branch", "attentive") and "cdf53" in names:
        names = ["haar", "db2"]
    x = np.random.default_rng(4).normal(size=(6, *shape))
    x[3], x[4] = 0.0, x[1]
    want = []
    try:
        want = [wavelets.decompose(t, level, **({"family": "haar"} | ({} if name == "fixed" else wavelets.policy(name, t, names)))) for t in x]
    except ValueError:  # bands of different lengths can't be mixed
        pass
    stack = np.moveaxis(x, 0, -1)
    how = packet_batches.policy(name, len(shape), names)
    if not want:
        with pytest.raises(ValueError):
            list(packet_batches.decompose(stack, level, **how))
        return
    seen = set()
    for rows, trees in packet_batches.decompose(stack, level, **how):
        for k, i in enumerate(rows):
            seen.add(i)
            own = trees.families | {p: [how["names"][c] for c in v[:, k]] for p, v in trees.chosen.items()}
            assert own == want[i].families and list(trees.nodes) == list(want[i].nodes)
            assert all(trees.nodes[p][..., k].shape == v.shape and np.allclose(trees.nodes[p][..., k], v, atol=1e-12) for p, v in want[i].nodes.items())
            if level == 1 and "cdf53" not in names:  # else bands of different lengths may not fit together
                assert np.allclose(wavelets.reconstruct(trees)[..., k], wavelets.reconstruct(want[i]), atol=1e-12)
    assert seen == set(range(6))


def test_packets_of_a_table_and_their_tensors(spark):
    rng = np.random.default_rng(9)
    made = {i: rng.normal(size=s) for i, s in enumerate([(4, 4), (4, 4), (8,), (4, 4), (2, 2, 4)])}
    rows = [(i, list(x.shape), x.reshape(-1).tolist()) for i, x in made.items()]
    tensors = spark.createDataFrame([*rows, (9, [4], None)], "tid long, shape array<int>, data array<double>")
    for name in ("spatial", "subband"):
        tree = vectors.packets(tensors, 1, "haar", name, candidates=["haar", "db2"])
        got = {(r["tid"], r["path"]): r for r in tree.collect()}
        for i, x in made.items():
            want = wavelets.decompose(x, 1, **({"family": "haar"} | wavelets.policy(name, x, ["haar", "db2"])))
            for p, v in want.nodes.items():
                r = got.pop((i, p))
                assert (r["shape"], r["level"], r["families"]) == (list(v.shape), int(p != ""), want.families.get(p)) and np.allclose(r["data"], v.reshape(-1))
        assert not got
        back = {r["tid"]: (r["shape"], r["data"]) for r in vectors.from_packets(tree).collect()}
        straight = {r["tid"]: (r["shape"], r["data"]) for r in vectors.rebuilt(tensors, 1, "haar", name, candidates=["haar", "db2"]).collect()}
        assert set(back) == set(straight) == set(made)
        assert all(back[i][0] == straight[i][0] and np.allclose(back[i][1], straight[i][1], atol=1e-12) for i in made)


def test_tensors_are_held_some_at_once(monkeypatch, spark):
    """The packets of one call hold no more tensors than fit, however many a batch brings."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"tid": list(range(3_000)), "shape": [[2, 2, 4, 4]] * 3_000, "data": [[0.0] * 64] * 3_000})
    sizes = [x.shape for _, x in vectors._stacks(batch)]
    assert sum(s[-1] for s in sizes) == 3_000 and max(s[-1] for s in sizes) * 64 <= vectors._VALUES
