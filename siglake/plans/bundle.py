"""Forensic bundles: a signal's manifest, audit trail, analysis, custody, seal and signature as one nested row, written as five JSON tables."""

from __future__ import annotations

import hashlib
import json
import platform
import secrets
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from siglake.operators.bits import hashes, timestamp_seal
from siglake.plans.report import sections
from siglake.sources.files import canonical, profile, sign

TABLES = ("manifest", "audit_trail", "analysis", "chain_of_custody")


@F.pandas_udf(BinaryType())
def double_bytes(samples: pd.Series) -> pd.Series:
    """Little-endian doubles one after the other."""
    return pd.Series([np.asarray(x, dtype="<f8").tobytes() for x in samples])


def event(number: Column, utc: str, actor: str, action: str, location: str, sha256: Column, notes: str | Column) -> Column:
    said = F.lit(notes) if isinstance(notes, str) else notes
    return F.struct(
        F.format_string("COC-%04d", number).alias("event_id"), F.lit(utc).alias("timestamp_utc"), F.lit(actor).alias("actor"),
        F.lit(action).alias("action"), F.lit(location).alias("location"), sha256.alias("item_sha256"), said.alias("notes"),
    )


def custody(case_id: str, sha256: Column, utc: str, actor: str, location: str, notes: str = "") -> Column:
    """A chain that begins with the acquisition of its evidence."""
    first = event(F.lit(1), utc, actor, "acquired", location, sha256, notes or "Initial acquisition record.")
    return F.struct(F.lit(case_id).alias("case_id"), sha256.alias("evidence_sha256"), F.lit(utc).alias("created_utc"), F.array(first).alias("events"))


def appended(chain: Column, utc: str, actor: str, action: str, location: str, item: Column | None = None, notes: str | Column = "") -> Column:
    """The chain with one more event, about the evidence where no other item is given; events are numbered from 1."""
    more = event(F.size(chain["events"]) + 1, utc, actor, action, location, chain["evidence_sha256"] if item is None else item, notes)
    return chain.withField("events", F.concat(chain["events"], F.array(more)))


def environment(utc: str) -> Column:
    return F.struct(F.lit(platform.python_version()).alias("python_version"), F.lit(platform.platform()).alias("platform"), F.lit(np.__version__).alias("numpy_version"), F.lit(utc).alias("analysis_utc"))


def step(name: str, utc: str, parameters: dict[str, Column], source: Column, result: Column, summary: dict[str, Column]) -> Column:
    """One step of an audit trail; parameters and summary are maps of text, so that steps of any kind stand in one list."""
    texts = lambda d: F.create_map(*[c for k, v in d.items() for c in (F.lit(k), v.cast("string"))])
    return F.struct(
        F.lit(name).alias("name"), F.lit(utc).alias("timestamp_utc"), texts(parameters).alias("parameters"),
        F.sha2(source, 256).alias("input_sha256"), F.sha2(result, 256).alias("output_sha256"), texts(summary).alias("summary"),
    )


def signature(body: Column, signer: str, utc: str, key: str | None) -> Column:
    @F.pandas_udf("struct<algorithm string, signature_hex string, scope_sha256 string>")
    def run(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for b in bodies:
            payload = json.loads(b)
            got = sign(payload, key or None)
            out.append((got["algorithm"], got["signature"], hashlib.sha256(canonical(payload)).hexdigest()))
        return pd.DataFrame(out, columns=["algorithm", "signature_hex", "scope_sha256"])

    s = run(body)
    return s.withField("signer", F.lit(signer)).withField("signed_utc", F.lit(utc)).withField("is_keyed", F.lit(bool(key)))


def bundles(
    signals: DataFrame, name: str = "generic_signal", *, evidence: DataFrame | None = None, case_id: str = "", examiner: str = "", notes: str = "",
    location: str = "lab-intake", authority: str = "local_clock_untrusted", signer: str = "", key: str | None = None, utc: str | None = None, nonce: str | None = None,
) -> DataFrame:
    """signals(sid, samples) to one row a signal: sid, manifest, profile, audit_trail, analysis, environment, timestamp_seal, chain_of_custody, report_signature.

    The evidence is `content` of evidence(sid, content), the bytes of the files, or the samples as
    doubles for signals that it lacks. Null samples count as none. The time and the nonce are
    drawn once, on the driver, and a signal's nonce derives from both and its sid, so a task that
    runs again gives the same row. The signature covers all but itself and the event that records it.
    """
    p, actor = profile(name), examiner or "unknown_examiner"
    utc, nonce = utc or datetime.now(UTC).replace(microsecond=0).isoformat(), nonce or secrets.token_hex(16)
    rows = signals.select("sid", F.coalesce("samples", F.array().cast("array<double>")).alias("samples")).withColumn("raw", double_bytes("samples"))
    rows = rows.join(evidence.select("sid", "content"), "sid", "left") if evidence is not None else rows.withColumn("content", F.lit(None).cast("binary"))
    held, kept, sid = F.col("content").isNotNull(), F.coalesce("content", "raw"), F.col("sid").cast("string")
    file = F.element_at(F.split(sid, "/"), -1)
    suffix = F.lower(F.regexp_extract(file, r"[^.]\.([^.]+)$", 1))
    report, layers = sections(p["sample_rate"], p["frame_size"], p["hop_size"])
    rows = rows.withColumn("kept", kept).withColumn("r", report).withColumn("layers", layers).withColumn("analysis", F.struct("r.*", "layers"))
    manifest = F.struct(
        F.when(held, file).otherwise("in_memory_signal").alias("source_name"),
        F.when(held, F.when(suffix == "", "binary").otherwise(suffix)).otherwise("in_memory_signal").alias("source_type"),
        F.length("kept").alias("size_bytes"), F.struct(*hashes(F.col("kept"))).alias("hashes"),
        F.lit(utc).alias("created_utc"), F.lit(case_id).alias("case_id"), F.lit(examiner).alias("examiner"), F.lit(notes).alias("notes"),
    )
    rows = rows.withColumn("manifest", manifest).withColumn("text", F.encode(F.to_json("analysis"), "UTF-8"))
    sha, said = F.col("manifest.hashes.sha256"), F.sha2("text", 256)
    trail = F.array(
        step("ingest_source", utc, {"profile": F.lit(name)}, F.when(held, F.encode(sid, "UTF-8")).otherwise(F.col("raw")), F.col("raw"), {"samples": F.size("samples"), "source_type": F.col("manifest.source_type")}),
        step("advanced_analysis", utc, {k: F.lit(p[k]) for k in ("sample_rate", "frame_size", "hop_size")}, F.col("raw"), F.col("text"), {"frame_count": F.col("r.frame_count"), "adaptive_event_count": F.col("r.events")}),
    )
    drawn = F.substring(F.sha2(F.concat_ws("|", F.lit(nonce), F.lit(utc), sid), 256), 1, 32)
    seal = F.struct(
        F.lit(utc).alias("sealed_utc"), F.lit(authority).alias("authority"), said.alias("source_sha256"), drawn.alias("nonce"),
        timestamp_seal(F.lit(utc), F.lit(authority), said, drawn).alias("seal_sha256"), F.lit(False).alias("trusted"),
    )
    chain = appended(custody(case_id or "UNSPECIFIED", sha, utc, actor, location, notes), utc, actor, "analyzed", location, notes=f"Profile={name}; sample_rate={p['sample_rate']}")
    rows = rows.select(
        "sid", "manifest", F.struct(*[F.lit(v).alias(k) for k, v in p.items()]).alias("profile"), trail.alias("audit_trail"), "analysis",
        environment(utc).alias("environment"), seal.alias("timestamp_seal"), chain.alias("chain_of_custody"),
    )
    rows = rows.withColumn("report_signature", signature(F.to_json(F.struct(*rows.columns)), signer or examiner, utc, key))
    sealed = F.concat(F.lit("algorithm="), F.col("report_signature.algorithm"))
    return rows.withColumn("chain_of_custody", appended(F.col("chain_of_custody"), utc, actor, "sealed_and_signed", location, F.col("report_signature.scope_sha256"), sealed))


def write_bundles(rows: DataFrame, folder: str) -> dict[str, str]:
    """Five JSON tables keyed by sid: the whole rows as forensic_report, then their parts, read from it so that signals are analysed once."""
    paths = {t: f"{folder}/{t}" for t in ("forensic_report", *TABLES)}
    rows.write.mode("overwrite").json(paths["forensic_report"])
    stored = rows.sparkSession.read.schema(rows.schema).json(paths["forensic_report"])
    for t in TABLES:
        stored.select("sid", t).write.mode("overwrite").json(paths[t])
    return paths
