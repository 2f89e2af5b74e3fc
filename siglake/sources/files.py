"""Files in and out: bytes, WAV, JSON, text and packet captures as tables; WAV and PNG writers; forensic records."""

from __future__ import annotations

import hashlib
import hmac
import io
import json
import struct
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siglake.errors import SignalValueError


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def decode(kind: str):
    """Column function from bytes to numbers; a partial record at the end is left out."""
    dtype = {"int16": "<i2", "uint16": "<u2", "float32": "<f4", "uint8": "u1"}[kind]

    @F.pandas_udf("array<double>")
    def run(content: pd.Series) -> pd.Series:
        size = np.dtype(dtype).itemsize
        return pd.Series([None if b is None else np.frombuffer(b[: len(b) // size * size], dtype=dtype).astype(float).tolist() for b in content])

    return run


def numeric_views(content: Column | str) -> Column:
    return F.struct(*[decode(k)(content).alias(k) for k in ("int16", "uint16", "float32", "uint8")])


def wav_samples(content: Column | str) -> Column:
    """16-bit samples over 32767, channels in turn."""

    def read(b):
        with wave.open(io.BytesIO(b)) as w:
            return (np.frombuffer(w.readframes(w.getnframes()), dtype="<i2") / 32767.0).tolist()

    @F.pandas_udf("array<double>")
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else read(b) for b in contents])

    return run(content)


def wav_bytes(samples, rate: int = 44100) -> bytes:
    """Mono, 16 bits, scaled to the peak, cut towards zero."""
    x = np.asarray(samples, dtype=float)
    peak = np.abs(x).max() if len(x) else 0.0
    pcm = np.clip(np.trunc(x / (peak if peak > 0 else 1.0) * 32767), -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.tobytes())
    return out.getvalue()


def pcap_packets(raw: bytes) -> list[tuple[float, int]]:
    """(time, length) of a capture file of the classic format."""
    if len(raw) < 24:
        return []
    order = "<" if raw[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    fine = 1e-9 if raw[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e-6
    at, out = 24, []
    while at + 16 <= len(raw):
        sec, sub, kept, size = struct.unpack(f"{order}IIII", raw[at : at + 16])
        out.append((sec + sub * fine, size))
        at += 16 + kept
    return out


def read_signals(spark: SparkSession, path: str, json_keys: tuple[str, ...] = ("samples", "signal", "data", "values")) -> DataFrame:
    """signals(sid, samples) of files by suffix: .json (a list, or the first list under a key), .wav, .pcap (sizes), .txt .md .log (code points), else bytes."""

    def load(name: str, raw: bytes) -> list[float]:
        suffix = name.rpartition(".")[2].lower() if "." in name else ""
        if suffix == "json":
            got = json.loads(raw)
            if isinstance(got, dict):
                got = next((got[k] for k in json_keys if isinstance(got.get(k), list)), None)
            if not isinstance(got, list):
                raise SignalValueError(f"no list of samples in {name}")
            return [float(v) for v in got]
        if suffix == "wav":
            with wave.open(io.BytesIO(raw)) as w:
                return (np.frombuffer(w.readframes(w.getnframes()), dtype="<i2") / 32767.0).tolist()
        if suffix == "pcap":
            return [float(n) for _, n in pcap_packets(raw)]
        if suffix in ("txt", "md", "log"):
            return [float(ord(c)) for c in raw.decode("utf-8", "ignore")]
        return [float(b) for b in raw]

    @F.pandas_udf("array<double>")
    def samples(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([load(n, c) for n, c in zip(names, contents, strict=True)])

    return read_bytes(spark, path).select(F.col("path").alias("sid"), samples("path", "content").alias("samples"))


def png_bytes(pixels: np.ndarray) -> bytes:
    """8-bit PNG of rows x columns (gray) or rows x columns x 3."""
    a = np.ascontiguousarray(pixels, dtype=np.uint8)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in a)
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def layer_images(layers: DataFrame) -> DataFrame:
    """(img, layer, png) from byte pixels(img, layer, r, c, v): an image is one group."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1))
        a[pdf["r"], pdf["c"]] = pdf["v"]
        return pd.DataFrame({"img": [pdf["img"].iloc[0]], "layer": [pdf["layer"].iloc[0]], "png": [png_bytes(a)]})

    return layers.groupBy("img", "layer").applyInPandas(draw, f"img {layers.schema['img'].dataType.simpleString()}, layer string, png binary")


def mosaic(tiles: list[np.ndarray], columns: int = 3, padding: int = 8) -> np.ndarray:
    """Tiles of one size side by side on white."""
    h, w = tiles[0].shape
    rows = -(-len(tiles) // columns)
    out = np.full((rows * (h + padding) + padding, columns * (w + padding) + padding), 255, dtype=np.uint8)
    for k, t in enumerate(tiles):
        y, x = padding + (k // columns) * (h + padding), padding + (k % columns) * (w + padding)
        out[y : y + h, x : x + w] = t
    return out


# Rate, frame and hop of profiles.
PROFILES = {
    "generic_signal": ("generic", 44100, 256, 128),
    "audio_voice": ("audio", 16000, 320, 160),
    "network_telemetry": ("network", 1000, 128, 64),
    "multimodal_probe": ("multimodal", 8000, 128, 64),
    "audio_forensics": ("audio", 48000, 512, 256),
    "image_forensics_scalarized": ("image", 4000, 256, 128),
    "network_forensics": ("network", 2000, 128, 64),
    "multimodal_forensics": ("multimodal", 12000, 256, 128),
}


def profile(name: str) -> dict:
    if name not in PROFILES:
        raise SignalValueError(f"no profile {name}")
    return dict(zip(("domain", "sample_rate", "frame_size", "hop_size"), PROFILES[name], strict=True)) | {"name": name}


def canonical(payload) -> bytes:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()


def sign(payload, key: bytes | str | None = None) -> dict:
    """HMAC of the canonical JSON, or its plain hash without a key."""
    body = canonical(payload)
    if key is None:
        return {"algorithm": "SHA256-DIGEST", "signature": hashlib.sha256(body).hexdigest()}
    return {"algorithm": "HMAC-SHA256", "signature": hmac.new(key.encode() if isinstance(key, str) else key, body, hashlib.sha256).hexdigest()}


def signed(rows: DataFrame, key: str | None = None) -> DataFrame:
    """rows with algorithm and signature of each row's JSON."""

    @F.pandas_udf("struct<algorithm string, signature string>")
    def run(body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sign(json.loads(b), key) for b in body])

    return rows.withColumn("_s", run(F.to_json(F.struct(*rows.columns)))).select(*rows.columns, "_s.*")
