"""Operators over signals(sid, samples) and tensors(tid, shape, data) whose kernels need arrays: Arrow-batched functions.

A signal or tensor is one row; nothing is gathered beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.functions import analysis, complex_tf, filters, packet_batches, states, wavelets

#: Values of tensors whose packets are made at once.
_VALUES = 1 << 15


def array_function(kernel: Callable, schema: str = "array<double>") -> Callable[[Column | str], Column]:
    """A kernel from one array to an array (or what schema says) as a column function; null stays null."""

    @F.pandas_udf(schema)
    def run(x: pd.Series) -> pd.Series:
        out = [None if v is None else kernel(np.asarray(v, dtype=float)) for v in x]
        return pd.Series([v.tolist() if isinstance(v, np.ndarray) else v for v in out])

    return run


def struct_function(kernel: Callable, schema: str) -> Callable[[Column | str], Column]:
    """A kernel from one array to a dict, as a column of structs."""

    @F.pandas_udf(schema)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernel(np.asarray(v, dtype=float)) for v in x])

    return run


def transform(signals: DataFrame, kernel: Callable, **options) -> DataFrame:
    """signals with samples replaced by kernel(samples, **options): filters, smoothers, envelopes and the like."""
    return signals.withColumn("samples", array_function(lambda x: np.asarray(kernel(x, **options), dtype=float))("samples"))


def bandpass(signals: DataFrame, rate: float, low: float, high: float) -> DataFrame:
    return transform(signals, filters.bandpass_fft, rate=rate, low=low, high=high)


def iir(signals: DataFrame, b: list[float], a: list[float]) -> DataFrame:
    return transform(signals, filters.apply_iir, b=b, a=a)


def envelope(signals: DataFrame) -> DataFrame:
    return transform(signals, lambda x: np.abs(complex_tf.analytic(x)))


def hilbert(signals: DataFrame) -> DataFrame:
    return transform(signals, lambda x: complex_tf.analytic(x).imag)


def kalman(signals: DataFrame, **options) -> DataFrame:
    return transform(signals, lambda x: states.kalman(x, **options)[0])


def wiener(signals: DataFrame, **options) -> DataFrame:
    return transform(signals, lambda x: states.wiener(x, **options)[0])


def adaptive_wiener(signals: DataFrame, **options) -> DataFrame:
    return transform(signals, lambda x: states.adaptive_wiener(x, **options)[0])


def particle_filter(signals: DataFrame, **options) -> DataFrame:
    return transform(signals, lambda x: states.particle_filter(x, **options)[0])


def lms(pairs: DataFrame, taps: int = 8, step: float = 0.01) -> DataFrame:
    """pairs(sid, desired, reference) with output, error and weights."""

    @F.pandas_udf("struct<output array<double>, error array<double>, weights array<double>>")
    def run(d: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(("output", "error", "weights"), (v.tolist() for v in filters.lms(a, b, taps, step)), strict=True)) for a, b in zip(d, r, strict=True)])

    return pairs.withColumn("x", run("desired", "reference")).select("sid", "x.*")


def spectrum(signals: DataFrame, full: bool = False) -> DataFrame:
    return signals.select("sid", array_function(lambda x: analysis.magnitudes(x, full))("samples").alias("magnitudes"))


def stft(signals: DataFrame, size: int = 256, hop: int = 128, window: str = "hann") -> DataFrame:
    """(sid, frame, bin, magnitude)."""
    m = array_function(lambda x: [r.tolist() for r in analysis.stft(x, size, hop, window)], "array<array<double>>")("samples")
    return signals.select("sid", F.posexplode(m).alias("frame", "row")).select("sid", "frame", F.posexplode("row").alias("bin", "magnitude"))


def spectrogram(signals: DataFrame, size: int = 256, hop: int = 128, window: str = "hann", log: bool = True) -> DataFrame:
    """(sid, frame, bin, level): magnitudes, in decibels unless log is false."""
    level = 20 * F.log10(F.greatest("magnitude", F.lit(1e-12))) if log else F.col("magnitude")
    return stft(signals, size, hop, window).select("sid", "frame", "bin", level.alias("level"))


SIGNATURE = (
    "sample_count long, frame_count long, mean_frame_rms double, mean_frame_zcr double, mean_frame_variance double, dominant_bins array<struct<bin:long,magnitude:double>>, spectral_energy double, "
    "spectral_flatness double, event_count long, peak_count long, first_derivative_energy double, second_derivative_energy double"
)


def _signature(x, **options) -> dict:
    s = analysis.signature(x, **options)
    return s | {"dominant_bins": [{"bin": b, "magnitude": m} for b, m in s["dominant_bins"]]}


def signatures(signals: DataFrame, **options) -> DataFrame:
    return signals.select("sid", struct_function(lambda x: _signature(x, **options), SIGNATURE)("samples").alias("s")).select("sid", "s.*")


def glyphs(signals: DataFrame) -> DataFrame:
    return signals.select("sid", array_function(lambda x: analysis.glyph(analysis.signature(x)))("samples").alias("glyph"))


def fingerprints(signals: DataFrame, rate: float = 44100, size: int = 256, hop: int = 128) -> DataFrame:
    return signals.select("sid", array_function(lambda x: analysis.fingerprint(x, rate, size, hop))("samples").alias("vector"))


LAYERS = "source_type string, sample_count long, bit_entropy double, event_count long, peak_count long, periodicity string, harmonic_structure string, expression string, glyph array<double>, signal_family string"


def layered(signals: DataFrame, kind: str = "unknown") -> DataFrame:
    return signals.select("sid", struct_function(lambda x: analysis.layered(x, kind), LAYERS)("samples").alias("s")).select("sid", "s.*")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fingerprints of one signal in two tables."""
    other = b.select("sid", F.col("vector").alias("w"))
    return a.join(other, "sid").select("sid", cosine(F.col("vector"), F.col("w")).alias("cosine"), euclidean(F.col("vector"), F.col("w")).alias("euclidean"))


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Names and values of tensors of one shape, some at once, the tensors along the last axis."""
    shapes = [tuple(s) for s in batch["shape"].to_pylist()]
    start = 0
    while start < len(shapes):
        most, end = start + max(1, _VALUES // max(1, math.prod(shapes[start]))), start + 1
        while end < min(most, len(shapes)) and shapes[end] == shapes[start]:
            end += 1
        flat = batch["data"].slice(start, end - start).flatten().cast(pa.float64())
        x = np.asarray(flat.fill_null(math.nan)).reshape(end - start, *shapes[start])
        yield batch["tid"].slice(start, end - start), np.ascontiguousarray(np.moveaxis(x, 0, -1))
        start = end


def _lists(x: np.ndarray) -> pa.Array:
    """Lists from the rows of x."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _grown(tensors: DataFrame, level: int, family, policy: str, options: dict, out: Callable, schema: str) -> DataFrame:
    """out(names, trees, names of families) of the packets of tensors(tid, shape, data), as many at a time as memory that doesn't grow with the table holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, x in _stacks(batch):
                how = packet_batches.policy(policy, x.ndim - 1, **options)
                for rows, trees in packet_batches.decompose(x, level, family, **how):
                    yield out(tid.take(pa.array(rows)), trees, how["names"])

    tid = tensors.schema["tid"].dataType.simpleString()
    return tensors.where("data is not null").select("tid", "shape", "data").mapInArrow(run, f"tid {tid}, {schema}")


def _nodes(tid: pa.Array, trees: packet_batches.Trees, names: list[str]) -> pa.RecordBatch:
    """A row a tensor and node; a tensor's nodes are side by side."""
    n, known = len(tid), wavelets.families()
    paths, nodes = list(trees.nodes), list(trees.nodes.values())
    places = np.array([known.index(f) for f in names])
    codes = [np.tile([known.index(f) for f in trees.families[p]], (n, 1)) if p in trees.families else places[trees.chosen[p].T] if p in trees.chosen else None for p in paths]
    none = np.tile([c is None for c in codes], n)
    column = lambda x: np.tile(np.array(x, dtype=np.int32), n)
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    chosen = pa.array(known, pa.string()).take(pa.array(np.concatenate([c for c in codes if c is not None], axis=1).reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [
            tid.take(pa.array(np.repeat(np.arange(n), len(paths)))), pa.array(paths).take(pa.array(column(range(len(paths))))), pa.array(column([p.count("/") + 1 if p else 0 for p in paths])),
            _lists(np.tile(np.array([v.shape[:-1] for v in nodes], dtype=np.int32), (n, 1))),
            pa.ListArray.from_arrays(ends(column([math.prod(v.shape[:-1]) for v in nodes])), pa.array(np.concatenate([v.reshape(-1, n) for v in nodes]).T.reshape(-1))),
            pa.ListArray.from_arrays(ends(np.where(none, 0, nodes[0].ndim - 1)), chosen, mask=pa.array(none)),
        ],
        ["tid", "path", "level", "shape", "data", "families"],
    )


def packets(tensors: DataFrame, level: int = 1, family="haar", policy: str = "fixed", **options) -> DataFrame:
    """tree(tid, path, level, shape, data, families): packets of tensors of any number of dimensions, by a policy of choosing and mixing."""
    return _grown(tensors, level, family, policy, options, _nodes, "path string, level int, shape array<int>, data array<double>, families array<string>")


def _tensors(tid: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    n = len(tid)
    return pa.RecordBatch.from_arrays([tid, _lists(np.tile(np.array(x.shape[:-1], dtype=np.int32), (n, 1))), _lists(x.reshape(-1, n).T)], ["tid", "shape", "data"])


def rebuilt(tensors: DataFrame, level: int = 1, family="haar", policy: str = "fixed", **options) -> DataFrame:
    """tensors(tid, shape, data) out of their own packets, which stay with their tensor: from_packets(packets(...)) without its exchange."""
    return _grown(tensors, level, family, policy, options, lambda tid, trees, _: _tensors(tid, wavelets.reconstruct(trees)), "shape array<int>, data array<double>")


def from_packets(tree: DataFrame) -> DataFrame:
    """tensors(tid, shape, data) from stored trees: a tensor's nodes are one row, bounded by the tensor; trees of the same families are put together at once."""
    packed = tree.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("path", "level", "shape", "data", "families"))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike: dict[tuple, list] = {}
            for i in range(batch.num_rows):
                nodes = batch["nodes"][i].values
                path, shape, families = (nodes.field(k).to_pylist() for k in ("path", "shape", "families"))
                key = (tuple(path), tuple(map(tuple, shape)), tuple(f and tuple(f) for f in families), max(nodes.field("level").to_pylist()))
                alike.setdefault(key, []).append((i, np.asarray(nodes.field("data").flatten())))
            for (paths, shapes, families, level), found in alike.items():
                trees, at = wavelets.Tree(np.zeros(0)), np.cumsum([0, *map(math.prod, shapes)])
                values = np.stack([x for _, x in found], axis=-1)
                trees.nodes = {p: values[a:b].reshape(*s, len(found)) for p, s, a, b in zip(paths, shapes, at, at[1:], strict=False)}
                trees.families = {p: list(f) for p, f in zip(paths, families, strict=True) if f is not None}
                trees.level = level
                yield _tensors(batch["tid"].take(pa.array([i for i, _ in found])), wavelets.reconstruct(trees))

    return packed.mapInArrow(run, tree.select("tid", "shape", "data").schema)


def complex_operator(signals: DataFrame, kernel: Callable, **options) -> DataFrame:
    """(sid, n, ch, re, im) of a complex kernel over signals(sid, re array<array<double>>[, im]), samples by channels."""
    has_imag = "im" in signals.columns

    def run(batches):
        for b in batches:
            rows = []
            for i, sid in enumerate(b["sid"]):
                x = np.array([np.asarray(r, dtype=float) for r in b["re"][i]]).astype(complex)
                x = x + 1j * np.array([np.asarray(r, dtype=float) for r in b["im"][i]]) if has_imag else x
                y = kernel(x, **options)
                y = complex_tf.channels(y[0] if isinstance(y, tuple) else y)
                n, c = np.indices(y.shape)
                rows.append(pd.DataFrame({"sid": sid, "n": n.ravel(), "ch": c.ravel(), "re": y.real.ravel(), "im": y.imag.ravel()}))
            yield pd.concat(rows) if rows else pd.DataFrame(columns=["sid", "n", "ch", "re", "im"])

    sid = signals.schema["sid"].dataType.simpleString()
    return signals.select("sid", "re", *(["im"] if has_imag else [])).mapInPandas(run, f"sid {sid}, n int, ch int, re double, im double")


def graph_operator(nodes: DataFrame, edges: DataFrame, kernel: Callable, **options) -> DataFrame:
    """(g, i, ch, v) of a dense kernel(x, adjacency[, edge features]) on each graph: nodes(g, i, ch, v), edges(g, i, j, w[, feat]). A graph is one group."""
    featured = "feat" in edges.columns

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        g = n["g"].iloc[0] if len(n) else e["g"].iloc[0]
        ids = np.sort(n["i"].unique())
        at = {k: p for p, k in enumerate(ids)}
        x = np.zeros((len(ids), int(n["ch"].max()) + 1 if len(n) else 1))
        x[[at[k] for k in n["i"]], n["ch"]] = n["v"]
        a = np.zeros((len(ids), len(ids)))
        known = e[e["i"].isin(at) & e["j"].isin(at)]
        rows, cols = [at[k] for k in known["i"]], [at[k] for k in known["j"]]
        a[rows, cols] = known["w"]
        args = [x, a]
        if featured:
            feats = np.zeros((len(ids), len(ids), max((len(f) for f in known["feat"]), default=1)))
            for r, c, f in zip(rows, cols, known["feat"], strict=True):
                feats[r, c] = f
            args.append(feats)
        y = kernel(*args, **options)
        y = np.asarray(y[0] if isinstance(y, tuple) else y, dtype=float)
        y = y[:, None] if y.ndim == 1 else y
        i, c = np.indices(y.shape)
        return pd.DataFrame({"g": g, "i": ids[i.ravel()] if len(y) == len(ids) else i.ravel(), "ch": c.ravel(), "v": y.ravel()})

    kind = nodes.schema["g"].dataType.simpleString()
    return nodes.groupBy("g").cogroup(edges.groupBy("g")).applyInPandas(run, f"g {kind}, i int, ch int, v double")


