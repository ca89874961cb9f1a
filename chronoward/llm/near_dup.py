"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and verification.

A document's shingles are runs of five words (all of its words, if fewer), weighted by one plus the logarithm of how often
they occur: a passage repeated many times must not outweigh the rest, since sets are what is compared in the end. Each
shingle is a Poisson process of arrivals, faster for larger weights; a register keeps the shingle that arrived first, and a
document's processes stop as soon as they are later than all of its registers. Bands of equal registers propose links,
the Jaccard similarity of the shingle sets confirms them (0.8 or more), and connected components are the classes.

Documents with the same words in the same order are folded together first; buckets compare every text with their smallest
one, and then all texts that are still in different components with each other, large buckets block by block.
Texts that are null, empty or blank belong to no group: their class is their own id. Every input row gives one output row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import gram_hashes, mix, signed, slices, sorted_set, word_hashes, written
from .components import components
from .crossing import crossing_links

WORDS, SIMILARITY, REGISTERS, BAND_ROWS = 5, 0.8, 64, 4
BANDS = REGISTERS // BAND_ROWS


def shingles(raw: bytes) -> np.ndarray:
    """Hashes of the shingles of a text, repeated as often as they occur."""
    words = word_hashes(raw)[0]
    return gram_hashes(words, min(WORDS, len(words))) if len(words) else words


def signature(hashes: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: for each register the shingle of the earliest arrival."""
    total = weights.sum()
    early = 8.0 * m * (np.log(m) + 4.0) / total  # arrivals later than this hardly ever count; checked below
    for limit in ((early, np.inf) if len(hashes) > 8 * m else (np.inf,)):
        times, owners = np.full(m, np.inf), np.zeros(m, dtype=np.uint64)
        ids, w, x, turn = hashes, weights.astype(float), np.zeros(len(hashes)), 0
        while True:
            turn += 1
            h = mix(ids + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            x = x - np.log(((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / w
            alive = x < min(limit, times.max())
            ids, w, x, h = ids[alive], w[alive], x[alive], h[alive]
            if not len(ids):
                break
            register = (mix(h) % np.uint64(m)).astype(np.int64)
            order = np.argsort(-x, kind="stable")
            order = order[x[order] < times[register[order]]]
            times[register[order]], owners[register[order]] = x[order], ids[order]  # the earliest is assigned last
        if times.max() < limit:
            break
    return owners


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the word sequence and the band hashes of every document that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for batch in slices(batches, 1_000):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                grams = shingles(raw)
                if doc_id is None or not len(grams):
                    continue
                same = np.frombuffer(hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest(), dtype=np.int64)
                hashes, counts = np.unique(grams, return_counts=True)
                who = signature(hashes, 1.0 + np.log(counts)).reshape(BANDS, BAND_ROWS)
                band = number
                for r in range(BAND_ROWS):
                    band = mix(band ^ who[:, r]) + np.uint64(r)
                out.append((doc_id, int(same[0]), int(same[1]), signed(band)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["doc_id", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted set of its shingles, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            sets = [sorted_set((shingles((t or "").encode()) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["id", "grams"])

    return docs.mapInArrow(run, "id long, grams array<int>")


def gram_sets(grams: pa.ChunkedArray) -> list[np.ndarray]:
    flat = grams.combine_chunks()
    values, ends = flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())
    return np.split(values, ends[:-1])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least SIMILARITY."""
    left, right = sets.toDF("a", "of_a"), sets.toDF("b", "of_b")
    joined = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    least, most = F.least(F.size("of_a"), F.size("of_b")), F.greatest(F.size("of_a"), F.size("of_b"))
    return joined.where(least >= most * SIMILARITY).where(shared >= (F.size("of_a") + F.size("of_b") - shared) * SIMILARITY).select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest id of the class) of every row, n_links: confirmed links of its text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(sketches(docs), "near-sketches")
    same = sketch.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"))
    copies = written(sketch.join(same, ["h1", "h2"]).groupBy("doc_id").agg(F.min("a").alias("a")), "near-copies")
    texts = sketch.join(copies.where("doc_id = a").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = written(texts.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket")), "near-buckets")
    first = rows.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    member = written(rows.join(first, "bucket").where("id <> a"), "near-members")
    pairs = member.select("a", F.col("id").alias("b")).distinct()
    candidates = member.select("id").union(member.select("a")).distinct()
    sets = written(shingle_sets(docs.join(candidates.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])), "near-sets")
    links = written(verified(pairs, sets), "near-links")
    roots = components(links)
    # within a bucket, texts that the smallest one did not reach: compare all that are still in different components
    everyone = member.select("bucket", "id").union(member.select("bucket", "a").distinct())
    done = pairs.select("a", "b")
    new = written(crossing_links(everyone, roots, sets, lambda found, of: verified(found.join(done, ["a", "b"], "left_anti"), of), gram_sets, SIMILARITY), "near-links", n=F.count("*"))
    if new.measured["n"]:
        links = written(links.union(new), "near-links")
        roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("a")).groupBy("a").agg(F.count("*").alias("n_links"))
    of = copies.join(roots.withColumnRenamed("id", "a"), "a", "left").join(degree, "a", "left").select("doc_id", F.coalesce("root", "a").alias("class_id"), "n_links")
    return docs.select("doc_id").join(of, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their class, with the columns that they came with.

    Rows without an id are in no class and stay. Rows that share one id stay or go together.
    """
    kept = classes(docs).where("doc_id = class_id").select("doc_id").distinct()
    without = docs.where("doc_id IS NULL").select(docs.columns)
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).union(without)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_links")


ORACLE = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id
"""
