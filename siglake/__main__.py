"""python -m siglake PATH [--forensic PROFILE] [--out FOLDER] [--bundle-dir FOLDER]: reports of files as JSON lines, and forensic bundles."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siglake.errors import SignalError
from siglake.plans import bundle, report
from siglake.sources.files import read_bytes, read_signals


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="siglake", description=__doc__)
    args.add_argument("path")
    args.add_argument("--forensic", metavar="PROFILE")
    args.add_argument("--sample-rate", type=float, default=44100)
    args.add_argument("--frame-size", type=int, default=256)
    args.add_argument("--hop-size", type=int, default=128)
    args.add_argument("--key")
    args.add_argument("--case-id", default="")
    args.add_argument("--examiner", default="")
    args.add_argument("--bundle-dir")
    args.add_argument("--out")
    given = args.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        signals = read_signals(spark, given.path)
        out = report.forensic(signals, given.forensic, given.case_id, given.key) if given.forensic else report.analyze(signals, given.sample_rate, given.frame_size, given.hop_size)
        if given.bundle_dir:
            evidence = read_bytes(spark, given.path).select(F.col("path").alias("sid"), "content")
            rows = bundle.bundles(signals, given.forensic or "generic_signal", evidence=evidence, case_id=given.case_id, examiner=given.examiner, key=given.key)
            bundle.write_bundles(rows, given.bundle_dir)
        lines = out.select(F.to_json(F.struct("*")).alias("value"))
        if given.out:
            lines.write.text(given.out)
        else:
            for row in lines.toLocalIterator():
                print(row["value"])
    except (SignalError, OSError) as e:
        print(e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
