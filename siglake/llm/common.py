"""What the training-data operators share: packing of rows, scratch tables, word rules."""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What parts words, and what a word is.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pack(df: DataFrame, *extra: Column) -> DataFrame:
    """The whole input row as one struct `row`, so that no input name meets a working name."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *extra)


def unpack(df: DataFrame, added: list[str]) -> DataFrame:
    """`row` spread out again, then `added`; an input column of an added name gives way."""
    taken = {a.lower() for a in added}
    kept = [f.name for f in df.schema["row"].dataType.fields if f.name.lower() not in taken]
    return df.select(*[F.col("row." + quoted(c)).alias(c) for c in kept], *[F.col(a) for a in added])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siglake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siglake/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _hadoop_path(spark, path)[0].deleteOnExit(_hadoop_path(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        fs, path = _hadoop_path(df.sparkSession, df._scratch)
        fs.delete(path, True)


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Bytes of text that go to a Python worker at once, where the session names no number.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes for this session: a worker holds a batch's texts and all that it makes of them.

    Spark's own bound counts rows first, and 10,000 long texts can be gigabytes. It is read when
    a plan runs, so it stays set; a session that has its own keeps it.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory of a Python worker goes back to the machine: workers are reused, and else keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """mapInPandas over bounded batches; the worker gives memory back at the end of each task."""
    bound_batches(df.sparkSession)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        give_back()

    return df.mapInPandas(task, schema)


def column_of(spark: SparkSession, kernel: Callable[..., pd.Series], schema: str) -> Callable[..., Column]:
    """A kernel over the Series of a batch as a column function, with bounded batches."""
    bound_batches(spark)

    def task(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for b in batches:
            yield kernel(*b) if isinstance(b, tuple) else kernel(b)
        give_back()

    def frames(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        yield from task(batches)

    return F.pandas_udf(frames if schema.startswith("struct") else task, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, total_bytes: int, per_partition: int = 32 << 20) -> int:
    return max(shuffle_partitions(spark), math.ceil(total_bytes / per_partition))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def hashable(df: DataFrame) -> list[Column]:
    """The columns that xxhash64 takes: all but those with maps or variants inside."""
    return [F.col(quoted(f.name)) for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus == remainder
