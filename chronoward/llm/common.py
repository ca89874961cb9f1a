"""Shared helpers: reading tables, cutting lineage in the shared folder, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

WORD_CHARS = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a session on one machine gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronoward-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders made by `written` that are still there, in order.
MADE: list[str] = []


def written(df: DataFrame, label: str, **measures) -> DataFrame:
    """`df` as a Parquet table in the shared folder, so that a lost executor costs a reread, not a recomputation.

    `measures` are aggregates taken while writing; the result has them as `measured`, and its folder as `folder`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    watch = Observation() if measures else None
    source = df.observe(watch, *[e.alias(n) for n, e in measures.items()]) if measures else df
    source.write.option("compression", "zstd").parquet(path)
    MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder, out.measured = path, watch.get if measures else {}
    return out


def deleted(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders made by `written` once nothing reads them any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in MADE:
            MADE.remove(folder)


def dropped(df: DataFrame) -> None:
    """Deletes the files of one table made by `written`."""
    deleted(df.sparkSession, [df.folder])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, for bounded memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def split_of(doc_id="doc_id", folds: int = 4):
    """crc32 of the id written as text, modulo `folds`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), applied to every element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for reuse."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have, dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[int(base)] = have
    return have[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """P[i] = sum of values[j] * BASE**j for j < i, modulo 2**64."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end], the same wherever the values stand."""
    inverse = powers(BASE_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words: maximal runs of anything but space and tab .. carriage return."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, lowered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end byte of every word. With `lowered`, ASCII and other letters are folded first by the caller."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    prefix = prefix_hashes(mix(np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)))
    return range_hashes(prefix, starts, ends), starts, ends


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    return range_hashes(prefix_hashes(words), at, at + size)


def sorted_set(x: np.ndarray) -> np.ndarray:
    """The sorted different elements: a sort and one comparison, several times faster than hashing them."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
