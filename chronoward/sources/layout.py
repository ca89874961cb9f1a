"""Where tables lie: sites on disk, results with fingerprints, tables laid out by entity, reproducible samples."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which executors share; a session on one machine may have a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronoward-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = filesystem(spark, path)
    return fs.exists(where)


# sites


def site_folders(spark: SparkSession, root: str, not_sites: Sequence[str] = ()) -> list[str]:
    """Names of the site folders under a root in any store, in order.

    Folders whose names start with `_` or `.`, those known not to be sites, and folders without a file are left out.
    """
    fs, where = filesystem(spark, root)
    if not fs.exists(where):
        return []
    found = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if status.isDirectory() and not name.startswith(("_", ".")) and name not in not_sites and fs.listFiles(status.getPath(), True).hasNext():
            found.append(name)
    return sorted(found)


def stacked_sites(spark: SparkSession, root: str, table: str, not_sites: Sequence[str] = (), site: str = "site") -> DataFrame:
    """One table of every site, stacked, with the site's name. Columns that a site lacks are null; sites without the table give no rows."""
    root = root.rstrip("/")
    having = [s for s in site_folders(spark, root, not_sites) if exists(spark, f"{root}/{s}/{table}")]
    if not having:
        raise FileNotFoundError(f"no site under {root} has {table}")
    paths = [f"{root}/{s}/{table}" for s in having]
    if table.endswith(".csv"):
        frames = [spark.read.csv(p, header=True, inferSchema=True).withColumn(site, F.lit(s)) for p, s in zip(paths, having)]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out
    # one scan of all sites: the name comes from each file's own path
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    before = F.regexp_extract("_metadata.file_path", f"/([^/]+)/{re.escape(table.strip('/'))}(/|$)", 1)
    return rows.select("*", F.url_decode(F.replace(before, F.lit("+"), F.lit("%2B"))).alias(site))


# cached results


def fingerprint(spark: SparkSession, inputs: Sequence[DataFrame], version: str = "") -> str:
    """A digest of the files behind some tables (path, size, time of change) and of a version of the code."""
    files = sorted({f for df in inputs for f in df.inputFiles()})
    facts = []
    for f in files:
        fs, where = filesystem(spark, f)
        status = fs.getFileStatus(where)
        facts.append((f, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([version, facts]).encode()).hexdigest()[:24]


def result(spark: SparkSession, path: str, make: Callable[[], DataFrame], inputs: Sequence[DataFrame] = (), version: str = "", mode: str = "cached") -> DataFrame:
    """A result kept under `path`, by the fingerprint of what it was made from.

    Modes: external takes what is at `path` as it is and never makes anything; cached makes the result only where none of this
    fingerprint is there; fresh always makes it. A result appears by a rename once it is whole, and then takes the place of older ones.
    """
    if mode not in ("external", "cached", "fresh"):
        raise ValueError(f"no such mode: {mode}")
    path = path.rstrip("/")
    if mode == "external":
        return spark.read.parquet(path)
    mark = fingerprint(spark, inputs, version)
    target = f"{path}/result-{mark}"
    if mode == "fresh" or not exists(spark, f"{target}/_SUCCESS"):
        fs, _ = filesystem(spark, path)
        as_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        making = f"{path}/_making-{uuid.uuid4().hex}"
        make().write.parquet(making)
        fs.delete(as_path(target), True)
        if not fs.rename(as_path(making), as_path(target)):
            raise OSError(f"cannot rename {making}")
        for status in fs.listStatus(as_path(path)):  # results of other fingerprints
            name = status.getPath().getName()
            if name.startswith("result-") and name != f"result-{mark}":
                fs.delete(status.getPath(), True)
    return spark.read.parquet(target)


# entities


def write_by_entity(df: DataFrame, name: str, key: str, sort: Sequence[str] = (), buckets: int = 64, path: str | None = None) -> DataFrame:
    """A table in buckets of an entity, sorted: joins and groupings of such tables on the entity need no exchange, and a read of one entity opens one bucket."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


class EntityReader:
    """Rows of one entity at a time; the last few entities stay on the driver, each up to a number of rows."""

    def __init__(self, table: DataFrame, key: str, keep: int = 32, most_rows: int = 200_000):
        self.table, self.key, self.keep, self.most_rows = table, key, keep, most_rows
        self.kept: OrderedDict = OrderedDict()
        self.reads = 0

    def rows(self, value) -> list:
        if value in self.kept:
            self.kept.move_to_end(value)
            return self.kept[value]
        self.reads += 1
        found = self.table.where(F.col(self.key) == F.lit(value)).limit(self.most_rows + 1).collect()
        if len(found) > self.most_rows:
            raise ValueError(f"an entity of more than {self.most_rows} rows is read as a table, not as rows")
        self.kept[value] = found
        if len(self.kept) > self.keep:
            self.kept.popitem(last=False)
        return found


# samples


def hashed(key: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]).cast("binary"))


def sampled(df: DataFrame, key: Sequence[str], rows: int | None = None, share: float | None = None) -> DataFrame:
    """The same rows at every run: those whose key has the smallest hashes (`rows` of them), or a hash in a share of all hashes.

    A share is a filter; a number of rows needs no shuffle either, since every task keeps its smallest ones. Rows of one key come together in a
    share.
    """
    if share is not None:
        return df.where(F.substring(hashed(key), 1, 8) < F.lit(f"{min(int(share * 2**32), 2**32 - 1):08x}")) if share < 1 else df
    return df.orderBy(hashed(key), *key).limit(rows)
