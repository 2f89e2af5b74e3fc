"""Forensic bundles against hashes made by hand, families of signals, logging and the demo signal."""

import hashlib
import hmac
import json
import logging
import struct

import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from siglake.__main__ import main
from siglake.errors import SignalValueError
from siglake.logs import configure_logging, get_logger
from siglake.operators import families
from siglake.plans import bundle
from siglake.sources import tables
from siglake.sources.files import canonical, read_bytes, read_signals

UTC = "2024-01-02T03:04:05+00:00"
X = [0.0, 1.0, 0.5, -0.25, 0.75, -0.1, 0.2, 0.0]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def signals(spark, *rows):
    return spark.createDataFrame(list(rows), "sid string, samples array<double>")


def test_bundle_of_samples(spark):
    rows = bundle.bundles(signals(spark, ("a", X)), "network_telemetry", case_id="NET-42", examiner="Lab", key="k", utc=UTC, nonce="n")
    body = json.loads(rows.select(F.to_json(F.struct("*"))).first()[0])
    raw = struct.pack("<8d", *X)
    m = body["manifest"]
    assert (m["source_type"], m["size_bytes"], m["case_id"], m["examiner"], m["created_utc"]) == ("in_memory_signal", 64, "NET-42", "Lab", UTC)
    assert m["hashes"] == {"md5": hashlib.md5(raw).hexdigest(), "sha1": hashlib.sha1(raw).hexdigest(), "sha256": sha(raw)}
    assert body["profile"] == {"name": "network_telemetry", "domain": "network", "sample_rate": 1000, "frame_size": 128, "hop_size": 64}
    first, second = body["audit_trail"]
    assert (first["name"], first["input_sha256"], first["output_sha256"], first["summary"]["samples"]) == ("ingest_source", sha(raw), sha(raw), "8")
    assert (second["name"], second["input_sha256"], second["parameters"]["hop_size"]) == ("advanced_analysis", sha(raw), "64")
    seal = body["timestamp_seal"]
    assert seal["source_sha256"] == second["output_sha256"] and seal["nonce"] == sha(f"n|{UTC}|a".encode())[:32]
    assert seal["seal_sha256"] == sha(f"{UTC}|local_clock_untrusted|{seal['source_sha256']}|{seal['nonce']}".encode())
    chain = body["chain_of_custody"]
    assert [(e["event_id"], e["action"]) for e in chain["events"]] == [("COC-0001", "acquired"), ("COC-0002", "analyzed"), ("COC-0003", "sealed_and_signed")]
    signed = body.pop("report_signature")
    assert chain["events"].pop()["item_sha256"] == signed["scope_sha256"] == sha(canonical(body))
    assert signed["algorithm"] == "HMAC-SHA256" and signed["signature_hex"] == hmac.new(b"k", canonical(body), hashlib.sha256).hexdigest()


def test_bundles_of_null_empty_and_no_signals(spark):
    rows = {r["sid"]: r for r in bundle.bundles(signals(spark, ("n", None), ("e", [])), utc=UTC).collect()}
    for r in rows.values():
        assert r["manifest"]["size_bytes"] == 0 and r["manifest"]["hashes"]["sha256"] == sha(b"")
        assert r["chain_of_custody"]["case_id"] == "UNSPECIFIED" and r["report_signature"]["algorithm"] == "SHA256-DIGEST" and not r["report_signature"]["is_keyed"]
    assert bundle.bundles(signals(spark), utc=UTC).count() == 0
    with pytest.raises(SignalValueError):
        bundle.bundles(signals(spark), "none of these")


def test_written_bundles_have_the_files_evidence(spark, tmp_path):
    source, out = tmp_path / "Signal.JSON", tmp_path / "out"
    source.write_text(json.dumps(X))
    evidence = read_bytes(spark, str(source)).select(F.col("path").alias("sid"), "content")
    paths = bundle.write_bundles(bundle.bundles(read_signals(spark, str(source)), evidence=evidence), str(out))
    assert set(paths) == {"forensic_report", "manifest", "audit_trail", "analysis", "chain_of_custody"}
    m = spark.read.json(paths["manifest"]).first()["manifest"]
    assert (m["source_name"], m["source_type"], m["hashes"]["sha256"]) == ("Signal.JSON", "json", sha(source.read_bytes()))
    assert len(spark.read.json(paths["audit_trail"]).first()["audit_trail"]) == 2
    assert len(spark.read.json(paths["chain_of_custody"]).first()["chain_of_custody"]["events"]) == 3
    assert spark.read.json(paths["analysis"]).count() == spark.read.json(paths["forensic_report"]).count() == 1


def test_command_line_writes_bundles(spark, tmp_path, capsys):
    source, out = tmp_path / "signal.json", tmp_path / "bundle"
    source.write_text(json.dumps(X))
    assert main([str(source), "--forensic", "audio_voice", "--case-id", "VOICE-7", "--examiner", "Lab", "--bundle-dir", str(out)]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["case_id"] == "VOICE-7"
    report = spark.read.json(str(out / "forensic_report")).first()
    assert report["manifest"]["case_id"] == "VOICE-7" and report["profile"]["sample_rate"] == 16000


def test_events_are_appended(spark):
    rows = spark.range(2).select("id", bundle.custody("c", F.sha2(F.col("id").cast("string"), 256), UTC, "Lab", "desk").alias("chain"))
    got = rows.select("id", bundle.appended(F.col("chain"), UTC, "Lab", "moved", "shelf", notes="to the shelf").alias("chain")).orderBy("id").collect()
    for i, r in enumerate(got):
        first, second = r["chain"]["events"]
        assert (first["event_id"], first["action"], first["notes"]) == ("COC-0001", "acquired", "Initial acquisition record.")
        assert (second["event_id"], second["action"], second["location"], second["item_sha256"]) == ("COC-0002", "moved", "shelf", sha(str(i).encode()))


def test_families_tell_new_signals_from_a_saved_model(spark, tmp_path):
    known = spark.createDataFrame([(i, [float(10 * (i % 3)) + 0.01 * i, 0.0]) for i in range(30)] + [(99, None)], "sid long, vector array<double>")
    families.fit(known).write().save(str(tmp_path / "model"))
    model = KMeansModel.load(str(tmp_path / "model"))
    told = {r["sid"]: r["cluster"] for r in families.assign(model, known).collect()}
    assert len(told) == 30 and len(set(told.values())) == 3 and all(told[i] == told[i % 3] for i in range(30))
    new = spark.createDataFrame([(7, [10.4, 0.1])], "sid long, vector array<double>")
    assert families.assign(model, new).first()["cluster"] == told[1]


def test_logging_and_demo_signal(spark, capsys):
    configure_logging(logging.INFO, "%(name)s %(message)s")
    try:
        get_logger("siglake.x").info("read")
        assert "siglake.x read" in capsys.readouterr().err and get_logger().name == "siglake"
    finally:
        logging.basicConfig(level=logging.WARNING, force=True)
    x = tables.demo_signal(spark).first()["samples"]
    assert len(x) == 3000 and sum(x[400:430]) / 30 > 0.5 and abs(sum(x) / 3000) < 0.02
