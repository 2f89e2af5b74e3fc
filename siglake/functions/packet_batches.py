"""Wavelet packets of many tensors of one shape at once: every array has the tensors along its last axis.

What chooses and mixes is that of `wavelets`, written over that axis. Tensors that choose the same families are split together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np

from siglake.errors import SignalValueError, positive_int
from siglake.functions import wavelets

#: From a node to the place of a family among the names, by axis and tensor.
Choice = Callable[[np.ndarray], np.ndarray]


class Trees(wavelets.Tree):
    """Trees of tensors whose split nodes have the same families; chosen holds what bands chose that are not split yet, by axis and tensor."""

    def __init__(self, root: np.ndarray):
        super().__init__(root)
        self.chosen: dict[str, np.ndarray] = {}

    def take(self, rows: np.ndarray) -> Trees:
        out = Trees(self.nodes[""][..., rows])
        out.nodes = {p: v[..., rows] for p, v in self.nodes.items()}
        out.chosen = {p: v[:, rows] for p, v in self.chosen.items()}
        out.families, out.level = dict(self.families), self.level
        return out


# -- choosing families -----------------------------------------------------------------------------------------------------


def axis_scores(x: np.ndarray, names: list[str], criterion: str = "low_high_ratio") -> list[dict[str, np.ndarray]]:
    if criterion not in ("low_high_ratio", "energy_gap"):
        raise SignalValueError("criterion must be low_high_ratio or energy_gap")
    out = []
    for axis in range(x.ndim - 1):
        profile = x.mean(axis=tuple(a for a in range(x.ndim - 1) if a != axis))
        scores = {}
        for family in names:
            low, high = ((wavelets.along(profile, 0, taps, 2) ** 2).sum(axis=0) for taps in wavelets.filters(family)[:2])
            scores[family] = low / (high + 1e-12) if criterion == "low_high_ratio" else np.abs(low - high)
        out.append(scores)
    return out


def block_scores(x: np.ndarray, names: list[str], block: tuple[int, ...], criterion: str = "local_variation") -> list[dict[str, np.ndarray]]:
    if criterion not in ("local_variation", "low_high_ratio"):
        raise SignalValueError("criterion must be local_variation or low_high_ratio")
    shape, n = x.shape[:-1], x.shape[-1]
    total = [{f: np.zeros(n) for f in names} for _ in shape]
    for corner in product(*(range(0, k, positive_int(b, "block_shape")) for k, b in zip(shape, block, strict=True))):
        part = x[tuple(slice(c, c + b) for c, b in zip(corner, block, strict=True))]
        line = part.reshape(-1, n)
        step = np.abs(np.diff(line, axis=0)).mean(axis=0) if len(line) > 1 else 0.0
        weight = 1.0 + step if criterion == "local_variation" else 1.0
        for own, scores in zip(total, axis_scores(part, names), strict=True):
            for family, score in scores.items():
                own[family] += weight * score
    return total


def best(scores: list[dict[str, np.ndarray]]) -> np.ndarray:
    """The first of equals in the order of candidates, by axis and tensor."""
    out = []
    for own in scores:
        values = list(own.values())
        most, at = values[0], np.zeros(len(values[0]), dtype=np.int64)
        for k, v in enumerate(values[1:], 1):
            at, most = np.where(v > most, k, at), np.where(v > most, v, most)
        out.append(at)
    return np.stack(out)


def axis_weights(x: np.ndarray, initial=None, steps: int = 3, step_size: float = 0.1) -> np.ndarray:
    d, n = x.ndim - 1, x.shape[-1]
    weights = np.ones((d, n)) if initial is None else np.repeat(np.array(initial, dtype=float)[:, None], n, axis=1)
    change = np.stack([np.abs(np.diff(x, axis=a)).mean(axis=tuple(range(d))) if x.shape[a] > 1 else np.zeros(n) for a in range(d)])
    change = change / np.maximum(change.max(axis=0), 1e-12)
    for _ in range(positive_int(steps, "steps")):
        weights = np.maximum(weights + step_size * (change - change.mean(axis=0)), 0.1)
    return weights


# -- mixing ----------------------------------------------------------------------------------------------------------------


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / np.maximum(e.sum(axis=axis, keepdims=True), 1e-12)


def _cosine(lines: np.ndarray) -> np.ndarray:
    size = np.sqrt((lines * lines).sum(axis=1))
    return np.einsum("pmn,qmn->pqn", lines, lines) / np.maximum(size[:, None] * size[None, :], 1e-12)


def _lines(bands: dict[str, np.ndarray], paths: list[str]) -> tuple[np.ndarray, tuple[int, ...]]:
    stack = np.stack([bands[p] for p in paths])
    return stack.reshape(len(paths), -1, stack.shape[-1]), stack.shape[1:]


def mix_siblings(bands: dict[str, np.ndarray], tree: Trees) -> dict[str, np.ndarray]:
    out = {}
    groups: dict[str, list[str]] = {}
    for p in bands:
        groups.setdefault(p.rpartition("/")[0], []).append(p)
    for paths in groups.values():
        lines, shape = _lines(bands, paths)
        mixed = np.einsum("pqn,qmn->pmn", _soft(_cosine(lines), 1), lines)
        out.update((p, m.reshape(shape)) for p, m in zip(paths, mixed, strict=True))
    return out


def mix_cousins(bands: dict[str, np.ndarray], tree: Trees) -> dict[str, np.ndarray]:
    paths = list(bands)
    parent = np.array([p.rpartition("/")[0] for p in paths])
    other = (parent[:, None] != parent[None, :])[..., None]
    if not other.any():
        return bands
    lines, shape = _lines(bands, paths)
    share = _soft(np.where(other, _cosine(lines), -1e9), 1) * other
    mixed = 0.5 * lines + 0.5 * np.einsum("pqn,qmn->pmn", share, lines)
    return {p: m.reshape(shape) for p, m in zip(paths, mixed, strict=True)}


def mix_levels(bands: dict[str, np.ndarray], tree: Trees) -> dict[str, np.ndarray]:
    out = {}
    for p, band in bands.items():
        parts = [band, wavelets.fit_shape(tree.nodes[p.rpartition("/")[0]], band.shape), wavelets.fit_shape(tree.nodes[""], band.shape)]
        share = _soft(np.stack([np.abs(x).mean(axis=tuple(range(band.ndim - 1))) for x in parts]), 0)
        out[p] = sum(w * x for w, x in zip(share, parts, strict=True))
    return out


# -- trees -----------------------------------------------------------------------------------------------------------------


def policy(name: str, ndim: int, candidates: list[str] | None = None, block: tuple[int, ...] | None = None, criterion: str | None = None, **weights) -> dict:
    """Arguments of decompose for the named way to choose and mix families, as wavelets.policy says."""
    names = candidates or wavelets.families()
    block = block or tuple([1] * max(0, ndim - 3) + [4 if name in ("blockwise", "regularized", "multiobjective", "learnable") else 2] * min(3, ndim))
    scored = lambda x: block_scores(x, names, block, criterion or "local_variation")
    local = lambda x: best(scored(x))

    def weighed(x: np.ndarray) -> np.ndarray:
        shares = axis_weights(x, weights.get("axis_weights")) if name == "learnable" else weights.get("axis_weights")
        return best(wavelets.weigh(scored(x), shares, weights.get("precision", 1.0), weights.get("cost", 0.05), weights.get("stability", 0.05)))

    how = {
        "fixed": {},
        "adaptive": {"whole": lambda x: best(axis_scores(x, names, criterion or "low_high_ratio"))},
        "blockwise": {"whole": local},
        "regularized": {"whole": lambda x: best(wavelets.weigh(scored(x), cost=weights.get("complexity_lambda", 0.05)))},
        "multiobjective": {"whole": weighed},
        "learnable": {"whole": weighed},
        "spatial": {"select": local},
        "subband": {"select": local, "preset": True},
        "attentive": {"select": local, "preset": True, "mix": mix_siblings},
        "cross_branch": {"select": local, "mix": mix_cousins},
        "level_attentive": {"select": local, "mix": mix_levels},
    }
    if name not in how:
        raise SignalValueError(f"no policy {name}")
    return how[name] | {"names": names}


def _alike(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tensors with the same column of codes."""
    found, inverse = np.unique(codes, axis=1, return_inverse=True)
    for k in range(found.shape[1]):
        yield np.flatnonzero(inverse.reshape(-1) == k), found[:, k]


def decompose(x: np.ndarray, level: int = 1, family="haar", *, names: list[str] | None = None, whole: Choice | None = None, select: Choice | None = None, preset: bool = False, mix=None) -> Iterator[tuple[np.ndarray, Trees]]:
    """(which tensors, their trees). whole chooses the families of all splits from the tensor; select, preset and mix are those of wavelets.decompose."""
    x, ndim = np.asarray(x, dtype=float), x.ndim - 1
    positive_int(level, "level")

    def grow(rows: np.ndarray, tree: Trees, now: list[str], base: list[str]) -> Iterator[tuple[np.ndarray, Trees]]:
        if tree.level == level:
            yield rows, tree
            return
        codes = {p: tree.chosen[p] for p in now if p in tree.chosen} if preset else {p: select(tree.nodes[p]) for p in now} if select else {}
        for own, column in _alike(np.concatenate(list(codes.values()))) if codes else [(np.arange(len(rows)), None)]:
            part = tree.take(own)
            per_path = {p: [names[k] for k in column[i * ndim : (i + 1) * ndim]] for i, p in enumerate(codes)}
            bands = {}
            for path in now:
                part.families[path] = per_path.get(path, base)
                part.chosen.pop(path, None)
                bands |= {f"{path}/{name}" if path else name: b for name, b in wavelets.analyze(part.nodes[path], part.families[path]).items()}
            bands = mix(bands, part) if mix else bands
            part.nodes |= bands
            if preset and select:
                part.chosen |= _of_all(bands, select)
            part.level += 1
            yield from grow(rows[own], part, list(bands), base)

    for rows, column in _alike(whole(x)) if whole else [(np.arange(x.shape[-1]), None)]:
        yield from grow(rows, Trees(x[..., rows]), [""], wavelets._per_axis(family, ndim) if column is None else [names[k] for k in column])


def _of_all(bands: dict[str, np.ndarray], select: Choice) -> dict[str, np.ndarray]:
    """What every band chooses, those of one shape at once."""
    out, shapes = {}, {}
    for p, b in bands.items():
        shapes.setdefault(b.shape, []).append(p)
    for paths in shapes.values():
        out |= zip(paths, np.split(select(np.concatenate([bands[p] for p in paths], axis=-1)), len(paths), axis=1), strict=True)
    return out
