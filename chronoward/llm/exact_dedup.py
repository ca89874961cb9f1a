"""Exact deduplication by Grace hashing: spill files, recursive partitioning, open-addressing tables.

Two texts are copies when they are identical after deleting every space and tab .. carriage return. The work is that of a
Grace hash join turned into a grouping:

1. Fold. Every task puts its own rows through a small open-addressing table that compares complete contents, so a text with
   any number of copies leaves a task as one *entry* (the content, how many rows it stands for, the best of them).
2. Partition. Entries are dealt by a hash of their content to buckets and written as spill files in the shared folder. The
   entries of buckets whose distinct contents do not fit a table are dealt again by another hash, until all fit.
3. Table. Every bucket streams through one open-addressing table, which compares complete contents again and says for each
   entry what its group's best row and size are. Rows find their group through their entry, so no join has a key with more
   rows than one task has read.

Contents travel packed and are unpacked before they are compared: hashes only say where to look.

Defined results. A null text counts as empty; texts that are empty or white space alone are one group. Of a group, the row with
the most code points in its original text stays, then the smallest id (a missing id comes last), then any one of equal rows:
exactly one row of each group is kept. Repeated rows are rows of their own. An empty table gives an empty result. Columns other
than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, written

#: Bytes of distinct contents that a table holds, in a task's fold and in a bucket, and rows that a fold holds.
FOLD_BYTES, BUCKET_BYTES, FOLD_ROWS = 24 << 20, 24 << 20, 100_000
#: Bytes that leave a task at once.
BATCH_BYTES = 2 << 20
WHITE = b" \t\n\x0b\x0c\r"


class Table:
    """An open-addressing table of complete contents, numbered in the order in which they come; linear probing, half full at most."""

    def __init__(self):
        self.slots = [-1] * 256
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, hash_: int) -> Iterator[int]:
        mask = len(self.slots) - 1
        at = hash_ & mask
        while True:
            yield at
            at = (at + 1) & mask

    def number(self, hash_: int, content: bytes) -> int:
        """The number of a content, which is added if it is not there."""
        for at in self.place(hash_):
            n = self.slots[at]
            if n < 0:
                break
            if self.hashes[n] == hash_ and self.contents[n] == content:
                return n
        self.slots[at] = len(self.contents)
        self.hashes.append(hash_)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for n, h in enumerate(self.hashes):
                self.slots[next(at for at in self.place(h) if self.slots[at] < 0)] = n
        return len(self.contents) - 1


def better(chars: int, doc_id: int | None, row: int) -> tuple:
    """Smallest for the row that stays."""
    return -chars, doc_id is None, doc_id or 0, row


FOLDED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("entry", pa.int64()), ("hash", pa.int64()), ("size", pa.int64()),
    ("packed", pa.binary()), ("n", pa.int64()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.int64()),
])
FOLDED_DDL = "row long, doc_id long, sha binary, entry long, hash long, size long, packed binary, n long, best_chars long, best_id long, best_row long"


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every document; the first one of each entry carries the entry."""
    pack = zstandard.ZstdCompressor(level=1).compress
    here = TaskContext.get().partitionId() << 33
    seen, numbered, known, rows = 0, 0, Table(), []

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal numbered, known, rows
        n, best = [0] * len(known.contents), [None] * len(known.contents)
        for row, doc_id, chars, _, entry in rows:
            n[entry] += 1
            this = better(chars, doc_id, row)
            if best[entry] is None or this < best[entry][0]:
                best[entry] = this, chars, doc_id, row
        first, held, size, base = [True] * len(n), [], 0, here + numbered
        numbered += len(n)
        for row, doc_id, _, sha, entry in rows:
            ref = base + entry
            if first[entry]:
                first[entry] = False
                content = known.contents[entry]
                packed = pack(content)
                held.append((row, doc_id, sha, ref, known.hashes[entry] - (1 << 63), len(content), packed, n[entry], *best[entry][1:]))
                size += len(packed)
            else:
                held.append((row, doc_id, sha, ref, *[None] * 7))
            size += 100
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), FOLDED)], schema=FOLDED)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), FOLDED)], schema=FOLDED)
        known, rows = Table(), []

    for batch in batches:
        text = batch.column("text").fill_null("")
        for doc_id, chars, raw in zip(batch.column("doc_id").to_pylist(), pc.utf8_length(text).to_pylist(), text.cast(pa.binary())):
            content = raw.as_py().translate(None, WHITE)
            sha = hashlib.sha256(content).digest()
            rows.append((here + seen, doc_id, chars, sha, known.number(int.from_bytes(sha[:8], "little"), content)))
            seen += 1
            if known.bytes > FOLD_BYTES or len(rows) >= FOLD_ROWS:
                yield from out()
    yield from out()


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of their buckets, each with the best row and the size of its group."""
    unpack = zstandard.ZstdDecompressor().decompress
    now, known, groups, entries = None, Table(), [], []

    def out() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(entries), 50_000):
            some = entries[at : at + 50_000]
            of = [groups[g] for _, g in some]
            yield pa.RecordBatch.from_pydict({"of": pa.array([e for e, _ in some], pa.int64()), "keep_row": pa.array([g[0][-1] for g in of], pa.int64()), "keep_id": pa.array([g[1] for g in of], pa.int64()), "group_size": pa.array([g[2] for g in of], pa.int64())})

    for batch in batches:
        for level, bucket, entry, hash_, size, packed, n, chars, doc_id, row in zip(*(batch.column(c).to_pylist() for c in ENTRY)):
            if (level, bucket) != now:
                yield from out()
                now, known, groups, entries = (level, bucket), Table(), [], []
            g = known.number(hash_ + (1 << 63), unpack(packed, max_output_size=size) if size else b"")
            this = better(chars, doc_id, row)
            if g == len(groups):
                groups.append((this, doc_id, n))
            else:
                best, kept, total = groups[g]
                groups[g] = (min(best, this), doc_id if this < best else kept, total + n)
            entries.append((entry, g))
    yield from out()


ENTRY = ["level", "bucket", "entry", "hash", "size", "packed", "n", "best_chars", "best_id", "best_row"]


def dealt(rows: DataFrame, level: int, fan: int) -> DataFrame:
    """Rows by bucket in spill files; those without an entry are dealt by their own number, however many copies they are of."""
    bucket = F.pmod(F.xxhash64(F.coalesce("hash", "row"), F.lit(level)), F.lit(fan)).cast("int")
    return written(rows.withColumn("level", F.lit(level)).withColumn("bucket", bucket).repartition(fan, "bucket"), f"grace-{level}")


def grouped(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha of every row. `fan` is the number of buckets of the first level."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not fan:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so that all tasks of a stage get some
        fan = min(max(at_least, -(-2 * size // bucket_bytes)), 100_000)
    rows = dealt(docs.mapInArrow(fold, FOLDED_DDL), 0, fan)
    fitting, level, open_ = [], 0, rows.where("packed IS NOT NULL")
    total = fan
    while True:
        # what a table would hold: contents are told apart by their hash here, and only to choose a number of buckets
        once = open_.groupBy("bucket", "hash").agg(F.max("size").alias("size"))
        over = once.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > bucket_bytes) & (F.col("n") > 1))
        over = written(over, "grace-over", n=F.count("*"), bytes=F.sum("bytes"))
        fitting.append(open_.join(over.select("bucket"), "bucket", "left_anti").select(*ENTRY) if over.measured["n"] else open_.select(*ENTRY))
        if not over.measured["n"]:
            break
        level += 1
        if level > 30:
            raise RuntimeError("buckets do not get smaller")
        fan = max(2, -(-2 * over.measured["bytes"] // bucket_bytes))
        total += fan
        open_ = dealt(open_.join(over.select("bucket"), "bucket", "left_semi").drop("level", "bucket"), level, min(fan, 100_000))
    entries = fitting[0]
    for more in fitting[1:]:
        entries = entries.union(more)
    groups = entries.repartition(min(total, 100_000), "level", "bucket").sortWithinPartitions("level", "bucket").mapInArrow(tables, "of long, keep_row long, keep_id long, group_size long")
    of_row = rows.select("row", "doc_id", "sha", "entry")
    return of_row.join(groups, of_row["entry"] == groups["of"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` without all but one row of every group of copies. Rows that share both id and text stay or go together."""
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]", "").cast("binary"), 256)
    kept = grouped(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.lower(F.hex("sha")).alias("kept_sha"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), sha.alias("own_sha"))
    rows = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha") == F.col("kept_sha")), "left_semi")
    return rows.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(content) AS text_sha256
FROM texts WINDOW best AS (PARTITION BY content ORDER BY chars DESC, doc_id NULLS LAST)
"""
