"""Operators over samples(sid, idx, v): projections, statistics, detection and filters as windows, aggregates and joins.

Each keeps one shuffle on sid where its window or aggregate needs the signal together;
chained windows on one partitioning share it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from siglake.errors import SignalValueError, odd_window, positive_int
from siglake.functions import filters


def whole() -> WindowSpec:
    return Window.partitionBy("sid")


def ordered() -> WindowSpec:
    return Window.partitionBy("sid").orderBy("idx")


def _with(samples: DataFrame, value: Column) -> DataFrame:
    return samples.select("sid", "idx", value.alias("v"))


def normalize(samples: DataFrame) -> DataFrame:
    """By the largest magnitude."""
    return _with(samples, F.col("v") / F.greatest(F.max(F.abs(F.col("v"))).over(whole()), F.lit(1e-12)))


def detrend(samples: DataFrame) -> DataFrame:
    """Less the mean; also the removal of a direct-current part."""
    return _with(samples, F.col("v") - F.avg(F.col("v")).over(whole()))


def standardize(samples: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation; zeros for a constant signal."""
    spread = F.stddev_pop(F.col("v")).over(whole())
    return _with(samples, F.when(spread > 0, (F.col("v") - F.avg(F.col("v")).over(whole())) / spread).otherwise(0.0))


def anomaly_score(samples: DataFrame) -> DataFrame:
    return standardize(samples).withColumn("v", F.abs("v"))


def onset_strength(samples: DataFrame) -> DataFrame:
    """Rise of the magnitude; the first is 0, a signal of one sample has none."""
    rise = F.abs(F.col("v")) - F.lag(F.abs(F.col("v"))).over(ordered())
    return samples.select("sid", "idx", F.greatest(F.coalesce(rise, F.lit(0.0)), F.lit(0.0)).alias("v"), F.count(F.lit(1)).over(whole()).alias("of")).where("of > 1").drop("of")


def derivative(samples: DataFrame, order: int = 1) -> DataFrame:
    """Differences of neighbours, `order` times; `order` samples shorter."""
    out = samples
    for _ in range(positive_int(order, "order")):
        out = _with(out, F.lead("v").over(ordered()) - F.col("v")).where("v is not null")
    return out


def taper(n: Column, size: int, window: str) -> Column:
    """Symmetric tapers; a size of 1 is 1."""
    if window == "rect" or size == 1:
        return F.lit(1.0)
    turn = 2 * math.pi * n / (size - 1)
    if window == "hann":
        return 0.5 - 0.5 * F.cos(turn)
    if window == "hamming":
        return 0.54 - 0.46 * F.cos(turn)
    if window == "blackman":
        return 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn)
    raise SignalValueError(f"no window {window}")


def frames(samples: DataFrame, size: int = 256, hop: int = 128, window: str = "rect", pad_end: bool = False) -> DataFrame:
    """frames(sid, frame, n, v). A sample names the frames it stands in, so frames need no range join.

    pad_end: if the last full frame doesn't end with the signal, frames start at every hop and
    what is missing at the end is zero.
    """
    positive_int(size, "size"), positive_int(hop, "hop")
    of = F.count(F.lit(1)).over(whole())
    full = F.when(F.col("of") >= size, F.floor((F.col("of") - size) / hop) + 1).otherwise(0)
    last = (full - 1) * hop
    count = F.when((full == 0) | (last != F.greatest(F.col("of") - size, F.lit(0))), F.ceil(F.col("of") / hop)).otherwise(full) if pad_end else full
    counted = samples.withColumn("of", of).withColumn("count", count.cast("int"))
    low = F.greatest(F.floor((F.col("idx") - size) / hop) + 1, F.lit(0)).cast("int")
    high = F.least(F.floor(F.col("idx") / hop), F.col("count") - 1).cast("int")
    spread = counted.where(low <= high).select("sid", "idx", "v", F.explode(F.sequence(low, high)).alias("frame"))
    n = (F.col("idx") - F.col("frame") * hop).cast("int")
    out = spread.select("sid", "frame", n.alias("n"), "v")
    if pad_end:
        ends = counted.groupBy("sid").agg(F.max("of").alias("of"), F.max("count").alias("count")).where("count > 0").select("sid", "of", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("frame"))
        short = ends.withColumn("from", F.greatest(F.col("of") - F.col("frame") * hop, F.lit(0)).cast("int")).where(F.col("from") < size)
        out = out.unionByName(short.select("sid", "frame", F.explode(F.sequence(F.col("from"), F.lit(size - 1))).alias("n"), F.lit(0.0).alias("v")))
    return out.select("sid", "frame", "n", (F.col("v") * taper(F.col("n"), size, window)).alias("v"))


STATS = ("mean", "rms", "variance", "stddev", "median", "mad", "zero_crossing_rate", "peak_to_peak", "crest_factor", "energy", "waveform_length", "dynamic_range", "skewness", "kurtosis")


def statistics(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The fourteen statistics of a frame or a signal: one window for medians and neighbours, one aggregate."""
    group, line = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    seen = rows.select(*keys, order, "v").withColumn("middle", F.percentile("v", F.lit(0.5)).over(group)).withColumn("m", F.avg("v").over(group)).withColumn("before", F.lag("v").over(line))
    d = F.col("v") - F.col("m")
    crosses = ((F.col("before") >= 0) & (F.col("v") < 0)) | ((F.col("before") < 0) & (F.col("v") >= 0))
    out = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.avg(d * d).alias("variance"), F.first("middle").alias("median"),
        F.percentile(F.abs(F.col("v") - F.col("middle")), F.lit(0.5)).alias("mad"), F.sum(F.when(crosses, 1).otherwise(0)).alias("crossings"), (F.max("v") - F.min("v")).alias("peak_to_peak"),
        F.max(F.abs("v")).alias("peak"), F.min(F.when(F.col("v") != 0, F.abs("v"))).alias("low"), F.sum(F.col("v") * F.col("v")).alias("energy"), F.coalesce(F.sum(F.abs(F.col("v") - F.col("before"))), F.lit(0.0)).alias("waveform_length"),
        F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"),
    )
    spread = F.sqrt("variance")
    some = (F.col("n") > 1) & (F.col("variance") > 0)
    return out.select(
        *keys, "mean", "rms", "variance", spread.alias("stddev"), "median", "mad",
        F.when(F.col("n") > 1, F.col("crossings") / (F.col("n") - 1)).otherwise(0.0).alias("zero_crossing_rate"), "peak_to_peak",
        F.when(F.col("rms") > 0, F.col("peak") / F.col("rms")).otherwise(0.0).alias("crest_factor"), "energy", "waveform_length",
        F.when(F.col("peak") > 0, 20 * F.log10(F.col("peak") / F.greatest(F.col("low"), F.lit(1e-12)))).otherwise(0.0).alias("dynamic_range"),
        F.when(some, F.col("m3") / (spread * F.col("variance"))).otherwise(0.0).alias("skewness"), F.when(some, F.col("m4") / (F.col("variance") * F.col("variance"))).otherwise(0.0).alias("kurtosis"),
    )


def threshold_events(samples: DataFrame, threshold: float | None = None, z: float = 2.0) -> DataFrame:
    """events(sid, start, end, length): runs of magnitudes from the threshold on; without one, mean + z deviations."""
    if threshold is None:
        high = samples.withColumn("t", F.avg(F.abs(F.col("v"))).over(whole()) + z * F.stddev_pop(F.abs(F.col("v"))).over(whole())).where(F.abs(F.col("v")) >= F.col("t"))
    else:
        high = samples.where(F.abs(F.col("v")) >= threshold)
    runs = high.withColumn("run", F.col("idx") - F.row_number().over(ordered()))
    return runs.groupBy("sid", "run").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count(F.lit(1)).cast("int").alias("length")).drop("run")


def adaptive_threshold(samples: DataFrame, z: float = 2.0) -> DataFrame:
    return samples.groupBy("sid").agg((F.avg(F.abs(F.col("v"))) + z * F.stddev_pop(F.abs(F.col("v")))).alias("threshold"))


def local_peaks(samples: DataFrame, min_height: float = 0.0, min_distance: int = 1) -> DataFrame:
    """peaks(sid, idx, v): above the left, not below the right neighbour. Of peaks nearer than min_distance the first stays, unless the next is higher and takes its place."""
    near = samples.withColumn("left", F.lag("v").over(ordered())).withColumn("right", F.lead("v").over(ordered()))
    found = near.where((F.col("v") > F.col("left")) & (F.col("v") >= F.col("right")) & (F.col("v") >= min_height)).select("sid", "idx", "v")
    if min_distance <= 1:
        return found
    listed = found.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("p"))
    last = lambda a: F.element_at(a, -1)
    keep = F.aggregate(
        "p", F.slice("p", 1, 0),
        lambda a, x: F.when((F.size(a) == 0) | (x["idx"] - F.get(a, F.size(a) - 1)["idx"] >= min_distance), F.concat(a, F.array(x)))
        .when(x["v"] > last(a)["v"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x))).otherwise(a),
    )
    return listed.select("sid", F.explode(keep).alias("x")).select("sid", "x.idx", "x.v")


def moving_average(samples: DataFrame, size: int = 5) -> DataFrame:
    """Centred, with zeros outside the signal: always divided by the size."""
    positive_int(size, "size")
    return _with(samples, F.sum("v").over(ordered().rowsBetween(-(size // 2), (size - 1) // 2)) / size)


def rank_filter(samples: DataFrame, size: int = 5, rank: int | None = None) -> DataFrame:
    """The rank-th of the values in an odd window, edges repeated; the middle one by default."""
    half = odd_window(size) // 2
    rank = half if rank is None else rank
    if not 0 <= rank < size:
        raise SignalValueError("rank must lie within the window")
    near = F.collect_list("v").over(ordered().rowsBetween(-half, half))
    first, last = F.first("v").over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("v").over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wide = samples.select("sid", "idx", near.alias("near"), first.alias("first"), last.alias("last"), F.count(F.lit(1)).over(whole()).alias("of"))
    before = F.greatest(F.lit(half) - F.col("idx"), F.lit(0)).cast("int")
    after = F.greatest(F.col("idx") + half - (F.col("of") - 1), F.lit(0)).cast("int")
    return wide.select("sid", "idx", F.get(F.sort_array(F.concat(F.array_repeat("first", before), "near", F.array_repeat("last", after))), F.lit(rank)).alias("v"))


def median_filter(samples: DataFrame, size: int = 5) -> DataFrame:
    """An even window grows by one."""
    return rank_filter(samples, size + 1 - size % 2)


def dilate(samples: DataFrame, size: int = 3) -> DataFrame:
    half = odd_window(size) // 2
    return _with(samples, F.max("v").over(ordered().rowsBetween(-half, half)))


def erode(samples: DataFrame, size: int = 3) -> DataFrame:
    half = odd_window(size) // 2
    return _with(samples, F.min("v").over(ordered().rowsBetween(-half, half)))


def opening(samples: DataFrame, size: int = 3) -> DataFrame:
    return dilate(erode(samples, size), size)


def closing(samples: DataFrame, size: int = 3) -> DataFrame:
    return erode(dilate(samples, size), size)


def gradient(samples: DataFrame, size: int = 3) -> DataFrame:
    half = odd_window(size) // 2
    near = ordered().rowsBetween(-half, half)
    return _with(samples, F.max("v").over(near) - F.min("v").over(near))


def _filtered(samples: DataFrame, chains: list[list[list[float]]]) -> DataFrame:
    """(sid, idx, v0, v1, ...): by each chain, filters one after the other, of the same lengths in all chains. Convolutions as long as the longer of both, centred: the lags of one order over the signal and the zeros after it, so one sort does for all."""
    lengths = [len(taps) for taps in chains[0]]
    if not all(lengths):
        raise SignalValueError("a filter needs taps")
    sized = samples.select("sid", "idx", F.col("v").cast("double").alias("v"), F.count(F.lit(1)).over(whole()).alias("of"))
    reach = F.when(F.col("idx") == F.col("of") - 1, F.sequence(F.lit(0), F.lit(sum(lengths) - len(lengths)))).otherwise(F.array(F.lit(0)))
    now = sized.withColumn("on", F.explode(reach)).select("sid", (F.col("idx") + F.col("on")).alias("at"), F.when(F.col("on") == 0, F.col("v")).otherwise(0.0).alias("v"), "of")
    names, order = [f"v{i}" for i in range(len(chains))], Window.partitionBy("sid").orderBy("at")
    place, to = F.col("at"), F.col("of")  # in the signal so far, and how long it is
    for stage, k in enumerate(lengths):
        source = names if stage else ["v"] * len(chains)
        if stage:
            now = now.select("sid", "at", "of", *[F.when((place >= 0) & (place < to), F.col(x)).otherwise(0.0).alias(x) for x in names])
        now = now.select("sid", "at", "of", *[sum((F.lit(float(t)) * F.lag(x, j, 0.0).over(order) for j, t in enumerate(chain[stage])), F.lit(0.0)).alias(n) for n, x, chain in zip(names, source, chains, strict=True)])
        place, to = place - F.floor((F.least(to, F.lit(k)) - 1) / 2), F.greatest(to, F.lit(k))
    return now.select("sid", place.cast("int").alias("idx"), *names, to.alias("to")).where("idx >= 0 and idx < to").drop("to")


def apply_fir(samples: DataFrame, taps: list[float]) -> DataFrame:
    return _filtered(samples, [[taps]]).select("sid", "idx", F.col("v0").alias("v"))


def decimate(samples: DataFrame, factor: int, taps: list[float]) -> DataFrame:
    return apply_fir(samples, taps).where(F.col("idx") % factor == 0).select("sid", F.expr(f"idx div {factor}").cast("int").alias("idx"), "v")


def interpolate(samples: DataFrame, factor: int, taps: list[float]) -> DataFrame:
    """Zeros between samples, filtered, with the gain of the factor."""
    stuffed = samples.select("sid", F.posexplode(F.concat(F.array("v"), F.array_repeat(F.lit(0.0), factor - 1))).alias("k", "v"), "idx").select("sid", (F.col("idx") * factor + F.col("k")).alias("idx"), "v")
    return _with(apply_fir(stuffed, taps), F.col("v") * factor)


def haar_bank(samples: DataFrame) -> DataFrame:
    """(sid, band, idx, v): sums and differences of neighbours at every second sample."""
    before = F.coalesce(F.lag("v").over(ordered()), F.lit(0.0))
    both = samples.select("sid", "idx", ((F.col("v") + before) / math.sqrt(2)).alias("low"), ((F.col("v") - before) / math.sqrt(2)).alias("high")).where("idx % 2 = 0")
    return both.select("sid", F.expr("stack(2, 'low', low, 'high', high) as (band, v)"), F.expr("idx div 2").cast("int").alias("idx")).select("sid", "band", "idx", "v")


def haar_synthesis(bands: DataFrame) -> DataFrame:
    """samples from (sid, band, idx, v) of low and high; a band that ends first goes on with zeros."""
    of = lambda band: F.coalesce(F.sum(F.when(F.col("band") == band, F.col("v"))), F.lit(0.0)).alias(band)
    both = bands.groupBy("sid", "idx").agg(of("low"), of("high"))
    pair = F.array(F.col("low") + F.col("high"), F.col("low") - F.col("high"))
    return both.select("sid", "idx", F.posexplode(pair).alias("k", "v")).select("sid", (2 * F.col("idx") + F.col("k")).alias("idx"), (F.col("v") / math.sqrt(2)).alias("v"))


def bank(samples: DataFrame, bands: dict[int | str, list[list[float]]], factor: int) -> DataFrame:
    """(sid, band, idx, v): every so many samples behind each band's filters, which have the same lengths in all bands."""
    places = _filtered(samples, list(bands.values())).where(F.col("idx") % factor == 0)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"v{i}").alias("v")) for i, k in enumerate(bands)])).alias("x")
    return places.select("sid", F.expr(f"idx div {factor}").cast("int").alias("idx"), each).select("sid", "x.band", "idx", "x.v")


def uniform_bank(samples: DataFrame, bands: int = 4, taps: int = 31) -> DataFrame:
    """(sid, band, idx, v): bands of equal width, each brought to its own rate behind a second, shorter filter."""
    positive_int(bands, "bands")
    listed = lambda h: [float(t) for t in h]
    guard = listed(filters.lowpass(max(15, taps // 2), 0.45 / bands, 1.0))
    return bank(samples, {k: [listed(h), guard] for k, h in enumerate(filters.uniform_taps(bands, taps))}, bands)


def amplitude_modulation(carrier: DataFrame, modulator: DataFrame) -> DataFrame:
    """Carrier times (1 + modulator), as long as the shorter."""
    m = modulator.select("sid", "idx", F.col("v").alias("m"))
    return carrier.join(m, ["sid", "idx"]).select("sid", "idx", (F.col("v") * (1 + F.col("m"))).alias("v"))


def frequency_modulation(modulator: DataFrame, carrier_hz: float, sample_rate: float, index: float = 1.0) -> DataFrame:
    """Sine of the running phase."""
    step = 2 * math.pi * (carrier_hz + index * F.col("v")) / sample_rate
    return _with(modulator, F.sin(F.pmod(F.sum(step).over(ordered().rowsBetween(Window.unboundedPreceding, 0)), F.lit(2 * math.pi))))


def autocorrelation(samples: DataFrame, max_lag: int, normalized: bool = True) -> DataFrame:
    """(sid, lag, r) of the detrended signal for lags up to max_lag: each sample meets those that follow it in one window frame."""
    ahead = F.collect_list(F.struct("v")).over(ordered().rowsBetween(0, max_lag))
    lagged = detrend(samples).select("sid", "v", ahead.alias("ahead")).select("sid", "v", F.posexplode("ahead").alias("lag", "w"))
    sums = lagged.groupBy("sid", "lag").agg(F.sum(F.col("v") * F.col("w.v")).alias("r"))
    if not normalized:
        return sums
    zero = F.max(F.when(F.col("lag") == 0, F.col("r"))).over(whole())
    return sums.select("sid", "lag", F.when(F.abs(zero) > 1e-12, F.col("r") / zero).otherwise(F.col("r")).alias("r"))


def estimate_pitch(samples: DataFrame, sample_rate: float, min_hz: float = 50.0, max_hz: float = 1000.0) -> DataFrame:
    """Rate over the lag of the highest autocorrelation between the lags of max_hz and min_hz; the first of equals."""
    low, high = max(1, int(sample_rate / max_hz)), int(sample_rate / min_hz)
    best = autocorrelation(samples, high, False).where(F.col("lag").between(low, high)).groupBy("sid").agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"))
    return best.select("sid", (F.lit(float(sample_rate)) / F.col("lag")).alias("pitch"))


def dft(samples: DataFrame, size: int, bins: int | None = None) -> DataFrame:
    """spectrum(sid, bin, re, im, magnitude) of signals of one size: a sample goes to each bin, summed on the map side."""
    bins = size // 2 + 1 if bins is None else bins
    turn = -2 * math.pi / size
    spread = samples.select("sid", "idx", "v", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    angle = turn * ((F.col("bin") * F.col("idx")) % size)
    sums = spread.groupBy("sid", "bin").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    return sums.withColumn("magnitude", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def power_spectrum(spectrum: DataFrame) -> DataFrame:
    return spectrum.select("sid", "bin", (F.col("magnitude") * F.col("magnitude")).alias("power"))


def dominant_bins(spectrum: DataFrame, top: int = 8) -> DataFrame:
    """By rounded magnitude; the lower of equal bins first."""
    order = Window.partitionBy("sid").orderBy(F.round("magnitude", 6).desc(), "bin")
    return spectrum.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("sid", "rank", "bin", "magnitude")


def spectral_descriptors(spectrum: DataFrame, size: int, sample_rate: float, roll: float = 0.85, low_hz: float = 0.0, high_hz: float = math.inf) -> DataFrame:
    """Energy, flatness, centroid, bandwidth, rolloff and the energy of a band, of half spectra, in one aggregate after one window."""
    f, m = F.col("f"), F.col("magnitude")
    line = Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    seen = spectrum.withColumn("f", F.col("bin") * F.lit(float(sample_rate)) / size).withColumn("p", m * m)
    seen = seen.withColumn("total", F.sum("p").over(whole())).withColumn("run", F.sum("p").over(line)).withColumn("c", F.coalesce(F.sum(f * m).over(whole()) / F.nullif(F.sum(m).over(whole()), F.lit(0.0)), F.lit(0.0)))
    rest = f - F.col("c")
    return seen.groupBy("sid").agg(
        F.sum("p").alias("energy"), F.coalesce(F.exp(F.avg(F.when(m > 0, F.log(m)))) / F.avg(F.when(m > 0, m)), F.lit(0.0)).alias("flatness"), F.first("c").alias("centroid"),
        F.coalesce(F.sqrt(F.sum(rest * rest * m) / F.nullif(F.sum(m), F.lit(0.0))), F.lit(0.0)).alias("bandwidth"),
        F.min(F.when(F.col("run") >= roll * F.col("total") - 1e-9, f)).alias("rolloff"), F.coalesce(F.sum(F.when((f >= low_hz) & (f < high_hz), F.col("p"))), F.lit(0.0)).alias("band_energy"),
    )


def timeline(samples: DataFrame, size: int) -> DataFrame:
    """(sid, block, energy, mean, peak) of tumbling blocks of `size` samples; a partial one at the end is left out."""
    blocks = samples.withColumn("block", F.expr(f"idx div {positive_int(size, 'size')}").cast("int"))
    return blocks.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * F.col("v")).alias("energy"), F.avg("v").alias("mean"), F.max(F.abs("v")).alias("peak")).where(F.col("n") == size).drop("n")


def timeline_summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("sid").agg(F.count(F.lit(1)).alias("windows"), F.avg("energy").alias("avg_energy"), F.max("energy").alias("max_energy"), F.var_pop("energy").alias("energy_variance"))


def one_pole(samples: DataFrame, gain: float, feedback: float) -> DataFrame:
    """y[n] = gain * x[n] + feedback * y[n-1] by a fold over each signal (leaky integrators, single-pole filters, exponential smoothing)."""
    listed = samples.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("p"))
    fold = F.aggregate("p", F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("out")), lambda s, x: F.struct((gain * x["v"] + feedback * s["y"]).alias("y"), F.concat(s["out"], F.array(gain * x["v"] + feedback * s["y"])).alias("out")), lambda s: s["out"])
    return listed.select("sid", F.posexplode(fold).alias("idx", "v"))
