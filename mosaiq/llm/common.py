"""Plumbing shared by the corpus operators: scratch tables, row batches and word hashing.

Scratch tables are parquet files below the folder named in ``spark.checkpoint.dir``, which
every executor can read; a lost executor therefore never takes finished work with it.
"""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; bounds the Python workers' memory where texts are long.
BATCH_ROWS = 512

WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_roots: dict[str, str] = {}


def process_cache(name: str) -> dict:
    """A dict that lives as long as the worker process, and never travels with a task."""
    home = sys.modules.setdefault("_mosaiq_process", types.ModuleType("_mosaiq_process"))
    return home.__dict__.setdefault(name, {})


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session; the setting stays, since plans run after the call that made them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a local one only on a local master that leaves it unset."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="mosaiq-")
        _roots[app] = f"{base.rstrip('/')}/mosaiq-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _roots[app])
    return _roots[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is already gone; the folder is then left to the cluster's cleaner
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a scratch table and read it back: cuts the lineage and fixes the rows."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns(df: DataFrame, wanted: str) -> DataFrame:
    """The wanted columns ("name type, ..."), whatever else the table holds.

    A column is found by its exact name, else by a name that differs by case only; further
    columns whose names differ by case only, such as Text beside text, do no harm.
    """
    have, pairs = df.columns, [w.split() for w in wanted.split(", ")]
    at = {}
    for name, _ in pairs:
        alike = [i for i, c in enumerate(have) if c.lower() == name.lower()]
        at[next((i for i in alike if have[i] == name), alike[0] if alike else -1)] = name
    plain = df.toDF(*[at.get(i, f"__{i}") for i in range(len(have))])
    return plain.select(*[F.col(name).cast(kind).alias(name) for name, kind in pairs])


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator works on, whatever else the table holds."""
    return columns(docs, "doc_id long, text string")


#: Bits of the filter before a join; 8 MB whatever the tables hold, so it can be broadcast.
FILTER_BITS = 1 << 26


def may_match(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose columns `on` may be a row of keys: all that are, and some that are not.

    Put before a join it keeps most of the other rows from moving. keys is read twice, so it should
    be a written table; the more keys it has, the fewer rows the filter spares, and none is missed.
    The join after it should be an inner one: Catalyst pushes a semi join below this filter.
    """
    number = F.pmod(F.xxhash64(*on, F.lit(3)), F.lit(FILTER_BITS)) + 1
    bits = keys.select(F.bitmap_bucket_number(number).alias("__bucket"), F.bitmap_bit_position(number).alias("__at"))
    bits = cut(bits.groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits")), "filter")
    marked = rows.withColumn("__bucket", F.bitmap_bucket_number(number)).withColumn("__at", F.bitmap_bit_position(number)).join(F.broadcast(bits), "__bucket")
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__at") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return marked.where(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1).select(*rows.columns)


# --- word hashing over whole batches -------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    powers = process_cache("powers")
    have = powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of `width` consecutive 64-bit values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    v = mix(values ^ np.uint64(salt)) if salt else values
    prefix = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * _power(_BASE, len(v), "b"), out=prefix[1:])
    return mix((prefix[width:] - prefix[:n]) * _power(_INV, n, "i"))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the runs values[starts[i]:ends[i]]; runs of different lengths differ."""
    v = mix(values ^ np.uint64(salt)) if salt else values
    prefix = np.zeros(len(v) + 1, np.uint64)
    if len(v):
        np.cumsum(v * _power(_BASE, len(v), "b"), out=prefix[1:])
    run = (prefix[ends] - prefix[starts]) * _power(_INV, len(v) + 1, "i")[starts]
    return mix(run ^ mix((ends - starts).astype(np.uint64) + np.uint64(1)))


def word_hashes(buffer: bytes) -> np.ndarray:
    """64-bit hash of each whitespace-separated word of a byte string, in order."""
    b = np.frombuffer(buffer, np.uint8)
    n = len(b)
    if not n:
        return np.empty(0, np.uint64)
    inside = np.empty(n + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    inside[1:-1] &= 1
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hash(b.astype(np.uint64) + np.uint64(1), starts, ends)
