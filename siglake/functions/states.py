"""State estimation on one signal: Kalman filters of four kinds, Wiener filters, particle filters and smoothers."""

from __future__ import annotations

import numpy as np

from siglake.errors import SignalValueError, odd_window, positive_int


def _local(x: np.ndarray, size: int, pad: str) -> tuple[np.ndarray, np.ndarray]:
    half = odd_window(size) // 2
    near = np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode=pad), size)
    return near.mean(1), near.var(1)


def wiener(x, size: int = 5, noise: float | None = None, pad: str = "reflect"):
    """(filtered, local mean, local variance, noise)."""
    x = np.asarray(x, dtype=float)
    if not len(x):
        return x, x, x, 0.0
    mean, var = _local(x, size, pad)
    noise = float(var.mean()) if noise is None else float(noise)
    return mean + np.maximum(var - noise, 0) / np.maximum(var, 1e-12) * (x - mean), mean, var, noise


def adaptive_wiener(x, size: int = 5, rate: float = 0.1, pad: str = "reflect"):
    """(filtered, noise trace, local variance): the noise follows the local variance."""
    x = np.asarray(x, dtype=float)
    if not len(x):
        return x, x, x
    mean, var = _local(x, size, pad)
    noise, out, trace = float(x.var()), [], []
    for v, m, s in zip(x, mean, var, strict=True):
        noise = (1 - rate) * noise + rate * s
        out.append(m + max(s - noise, 0) / max(s, 1e-12) * (v - m))
        trace.append(noise)
    return np.array(out), np.array(trace), var


def kalman(z, process: float = 1e-5, measurement: float = 1e-2, initial: float | None = None, error: float = 1.0):
    """(estimates, gains, errors) of a constant level."""
    z = np.asarray(z, dtype=float)
    x, p, out = (float(z[0]) if initial is None else float(initial)) if len(z) else 0.0, float(error), []
    for v in z:
        p += process
        k = p / (p + measurement)
        x += k * (v - x)
        p *= 1 - k
        out.append((x, k, p))
    return tuple(np.array(out).reshape(-1, 3).T)


def extended_kalman(z, f, h, jf, jh, x0, p0, q, r):
    """(estimates, covariances); f and h move and measure, jf and jh are their Jacobians."""
    x, p, q, r = (np.atleast_1d(np.asarray(x0, dtype=float)), *(np.atleast_2d(np.asarray(m, dtype=float)) for m in (p0, q, r)))
    xs, ps = [], []
    for v in z:
        j = np.atleast_2d(jf(x))
        x, p = np.atleast_1d(f(x)), j @ p @ j.T + q
        m = np.atleast_2d(jh(x))
        k = p @ m.T @ np.linalg.inv(m @ p @ m.T + r)
        x = x + k @ (np.atleast_1d(v) - np.atleast_1d(h(x)))
        p = (np.eye(len(x)) - k @ m) @ p
        xs.append(x)
        ps.append(p)
    return np.array(xs), np.array(ps)


def sigma_points(x, p, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0):
    n = len(x)
    lam = alpha**2 * (n + kappa) - n
    root = np.linalg.cholesky((n + lam) * (p + 1e-12 * np.eye(n)))
    points = np.vstack([x, x + root.T, x - root.T])
    wm = np.full(2 * n + 1, 1 / (2 * (n + lam)))
    wc = wm.copy()
    wm[0], wc[0] = lam / (n + lam), lam / (n + lam) + 1 - alpha**2 + beta
    return points, wm, wc


def unscented_kalman(z, f, h, x0, p0, q, r, **shape):
    x, p, q, r = (np.atleast_1d(np.asarray(x0, dtype=float)), *(np.atleast_2d(np.asarray(m, dtype=float)) for m in (p0, q, r)))
    xs, ps = [], []
    for v in z:
        s, wm, wc = sigma_points(x, p, **shape)
        s = np.array([np.atleast_1d(f(k)) for k in s])
        x = wm @ s
        p = (s - x).T @ np.diag(wc) @ (s - x) + q
        y = np.array([np.atleast_1d(h(k)) for k in s])
        m = wm @ y
        k = (s - x).T @ np.diag(wc) @ (y - m) @ np.linalg.inv((y - m).T @ np.diag(wc) @ (y - m) + r)
        p = p - k @ ((y - m).T @ np.diag(wc) @ (y - m) + r) @ k.T
        x = x + k @ (np.atleast_1d(v) - m)
        xs.append(x)
        ps.append(p)
    return np.array(xs), np.array(ps)


def particles(z, move, likelihood, start, seed: int | np.random.Generator = 42):
    """(estimates, particles, weights): bootstrap, drawn anew in every step. move(particles, rng), likelihood(v, particles)."""
    rng, now, out = np.random.default_rng(seed), np.asarray(start, dtype=float).copy(), []
    w = np.full(len(now), 1 / max(len(now), 1))
    for v in z:
        now = np.asarray(move(now, rng), dtype=float)
        w = np.maximum(np.asarray(likelihood(v, now), dtype=float).reshape(len(now)), 1e-300)
        w = w / w.sum()
        out.append(w @ now)
        now = now[rng.choice(len(now), len(now), p=w)]
    return np.array(out), now, w


def particle_filter(z, count: int = 100, process: float = 0.1, measurement: float = 0.2, start=None, seed: int = 42):
    z = np.asarray(z, dtype=float)
    rng = np.random.default_rng(seed)  # the same generator draws the start and all that follows
    if start is None:
        start = rng.normal(z[0] if len(z) else 0.0, measurement, positive_int(count, "num_particles"))
    start = np.asarray(start, dtype=float)
    if start.ndim != 1:
        raise SignalValueError("particles of a scalar state are one-dimensional")
    return particles(z, lambda p, rng: p + rng.normal(0, process, len(p)), lambda v, p: np.exp(-0.5 * ((v - p) / measurement) ** 2), start, rng)


def backward_smoother(x, alpha: float = 0.3) -> np.ndarray:
    y = np.asarray(x, dtype=float).copy()
    for i in range(len(y) - 2, -1, -1):
        y[i] = alpha * y[i] + (1 - alpha) * y[i + 1]
    return y


def rts_smoother(xs, ps, f, q):
    """Backward pass over filtered estimates (steps x states) and covariances."""
    xs, ps, f, q = np.array(xs, dtype=float), np.array(ps, dtype=float), np.atleast_2d(f), np.atleast_2d(q)
    if xs.ndim != 2:
        raise SignalValueError("estimates must be steps by states")
    for t in range(len(xs) - 2, -1, -1):
        ahead = f @ ps[t] @ f.T + q
        g = ps[t] @ f.T @ np.linalg.inv(ahead)
        xs[t] = xs[t] + g @ (xs[t + 1] - f @ xs[t])
        ps[t] = ps[t] + g @ (ps[t + 1] - ahead) @ g.T
    return xs, ps
