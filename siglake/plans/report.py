"""The whole analysis of signals as one nested row each, and its forensic form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.functions import analysis
from siglake.operators.bits import hashes
from siglake.operators.vectors import LAYERS, SIGNATURE, _signature, struct_function
from siglake.sources.files import profile, signed

REPORT = (
    f"signature struct<{SIGNATURE.replace(' long', ':long').replace(' double', ':double').replace('dominant_bins array', 'dominant_bins:array')}>, "
    "frame_count long, mean_features array<double>, fingerprint array<double>, threshold double, events long, anomaly_max double, onset_mean double, spectrogram_frames long, spectrogram_bins long, autocorrelation array<double>"
)


def _report(x: np.ndarray, rate: float, size: int, hop: int) -> dict:
    p = analysis.prepared(x)
    table = [analysis.statistics(f) for f in analysis.frames(p, size, hop, "hann", True)]
    spread = p.std() if len(p) else 0.0
    threshold = analysis.adaptive_threshold(p)
    shape = analysis.spectrogram(p, size, hop).shape
    rise = np.maximum(np.diff(np.abs(p)), 0)
    return {
        "signature": _signature(p, size=size, hop=hop), "frame_count": len(table), "mean_features": np.mean(table, axis=0).tolist() if table else [0.0] * len(analysis.STATS), "fingerprint": analysis.fingerprint(p, rate, size, hop),
        "threshold": threshold, "events": analysis.runs(p, threshold), "anomaly_max": float(np.abs(p - p.mean()).max() / spread) if spread else 0.0, "onset_mean": float(rise.sum() / len(p)) if len(p) else 0.0,
        "spectrogram_frames": shape[0], "spectrogram_bins": shape[1], "autocorrelation": analysis.autocorrelation(p)[:32].tolist(),
    }


def sections(rate: float, size: int, hop: int) -> tuple[Column, Column]:
    """The report and the layers of `samples` as two structs."""
    report = struct_function(lambda x: _report(x, rate, size, hop), REPORT)("samples")
    return report, struct_function(lambda x: analysis.layered(analysis.prepared(x)), LAYERS)("samples")


def analyze(signals: DataFrame, rate: float = 44100, size: int = 256, hop: int = 128) -> DataFrame:
    """signals(sid, samples) to (sid, sections of the report, layers)."""
    report, layers = sections(rate, size, hop)
    return signals.select("sid", report.alias("r"), layers.alias("layers")).select("sid", "r.*", "layers")


def forensic(signals: DataFrame, name: str = "generic_signal", case_id: str = "", key: str | None = None) -> DataFrame:
    """Reports by a profile, with the hashes of the samples and a signature of the row."""
    p = profile(name)
    out = analyze(signals, p["sample_rate"], p["frame_size"], p["hop_size"])
    evidence = signals.select("sid", *hashes(F.encode(F.array_join(F.transform("samples", lambda x: x.cast("string")), ","), "UTF-8")))
    return signed(out.join(evidence, "sid").withColumn("profile", F.lit(name)).withColumn("case_id", F.lit(case_id)), key)
