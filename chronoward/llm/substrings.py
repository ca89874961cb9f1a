"""Substring deduplication: words covered by a run of 20 words that also starts earlier are removed.

Streaming every document past the automaton of every reference shard costs documents times shards, so the shards are made
by content instead: winnowed fingerprints (the least hash of the 16 five-word grams inside each 20-word window; equal
windows pick equal grams) decide which windows can have a twin at all and to which shard they go. A shard is a set of
fingerprints; it holds the passages around them. Passages that are equal word by word are settled by a grouped minimum.
Fingerprints with several different passages go through suffix automata: each shard builds the automaton of its passages,
streams them through it for matching statistics, and reports for every stretch of at least 20 matching words where its
windows occur first. Minima over shards are grouped minima again, so a hot passage is spread over many tasks.

Windows are judged on the input. Null texts have no words. Words are runs of anything but space and tab to carriage
return, unchanged. Rows that share a document id are documents of their own, in the order of a hash of their text; rows
equal in both count as one document, so neither removes words of the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import dropped, gram_hashes, prefix_hashes, range_hashes, signed, slices, word_hashes, written

WINDOW, GRAM = 20, 5
REACH = WINDOW - GRAM + 1  # grams of a window
#: Passages of one automaton: a fingerprint with more is dealt over several shards.
SHARD_PASSAGES = 512
#: A place is a number of its document's tag, its first window and how many windows follow, so that places of one id sort by
#: tag, then window: TAG_BITS of the text's hash, 32 bits and 5 bits.
TAG_BITS, START_BITS, COUNT_BITS = 26, 32, 5


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first and last window of every run of windows that pick the same gram (the rightmost least one)."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    grams = gram_hashes(words, GRAM)
    # least gram of each window, by doubling: pick[i] covers `size` grams from i
    pick, size = np.arange(len(grams)), 1
    while size < REACH:
        step = min(size, REACH - size)
        left, right = pick[: len(pick) - step], pick[step:]
        pick = np.where(grams[right] <= grams[left], right, left)
        size += step
    new = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    return grams[pick[new]], new, np.concatenate([new[1:], [n]]) - 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """fp, passage hash, doc_id and place of every run of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            size = 0
            for doc_id, tag, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = word_hashes((text or "").encode())[0]
                fp, first, last = runs(words)
                if len(fp):
                    place = (tag << START_BITS + COUNT_BITS) + (first << COUNT_BITS) + (last - first)
                    parts.append((fp, passage_hashes(words, first, last), np.full(len(fp), doc_id), place))
                    size += len(fp)
                if size > 100_000:
                    yield out(parts)
                    parts, size = [], 0
            if parts:
                yield out(parts)

    def out(parts):
        fp, passage, doc, place = (np.concatenate([p[k] for p in parts]) for k in range(4))
        return pa.RecordBatch.from_arrays([pa.array(signed(fp)), pa.array(signed(passage)), pa.array(doc.astype(np.int64)), pa.array(place.astype(np.int64))], ["fp", "passage", "doc_id", "place"])

    return docs.mapInArrow(run, "fp long, passage long, doc_id long, place long")


def tag_of(place) -> Column:
    return F.shiftright(place, START_BITS + COUNT_BITS).cast("int")


def start_of(place) -> Column:
    return F.shiftright(place, COUNT_BITS).bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int")


def passage_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_hashes(words), first, last + WINDOW)


class Automaton:
    """Suffix automaton over several word sequences; a state keeps the earliest end of its words as (rank, position)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _new(self, length: int, first, edges: dict, link: int) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.first.append(first)
        return len(self.next) - 1

    def add(self, words: list, rank: int) -> None:
        """Adds a sequence; sequences come in the order of their ranks, so what is there already started earlier."""
        last = 0
        for i, w in enumerate(words):
            last = self._extend(last, w, (rank, i))

    def _extend(self, last: int, w, end) -> int:
        q = self.next[last].get(w)
        if q is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, q, w)
        cur = self._new(self.length[last] + 1, end, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w) -> int:
        clone = self._new(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def matches(self, words: list, least: int) -> Iterator[tuple[int, tuple]]:
        """Matching statistics: for every end with a match of at least `least` words, the earliest end of those last words."""
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            if length >= least:
                at = state
                while self.length[self.link[at]] >= least:
                    at = self.link[at]
                yield i, self.first[at]


def first_windows(passages: list[tuple[int, int, list]]) -> list[tuple[int, int, int, int, int]]:
    """For passages (doc_id, tag and first window, words) in order: hash, doc_id and place of each window, and of its first
    occurrence. Here a place is the tag and the window."""
    automaton, out = Automaton(), []
    for rank, (_, _, words) in enumerate(passages):
        automaton.add(words, rank)
    for doc, start, words in passages:
        hashes = window_hashes(words)
        for end, (rank, at) in automaton.matches(words, WINDOW):
            other, begin, _ = passages[rank]
            out.append((hashes[end - WINDOW + 1], doc, start + end - WINDOW + 1, other, begin + at - WINDOW + 1))
    return out


def window_hashes(words: list) -> list[int]:
    return signed(gram_hashes(np.array(words, dtype=np.int64).view(np.uint64), WINDOW)).tolist()


def settled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches (doc_id, tag, first and last word) whose passage has an equal one before it; and the first occurrences of
    passages that share a fingerprint with different ones, to be compared window by window.

    What is grouped by fingerprint is written before it is joined, so that adaptive execution can split hot ones.
    """
    found = written(fingerprints(docs), "fingerprints")
    # most fingerprints occur once and leave here
    twice = written(found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "repeated-fingerprints")
    shared = written(found.join(twice, "fp"), "shared-fingerprints")
    dropped(found)
    here = F.struct("doc_id", "place")
    passages = written(shared.groupBy("fp", "passage").agg(F.min(here).alias("first"), F.count("*").alias("n")), "passages")
    again = shared.join(passages.where("n > 1").select("fp", "passage", "first"), ["fp", "passage"]).where(here != F.col("first"))
    count = F.col("place").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")
    equal = again.select("doc_id", tag_of("place").alias("tag"), start_of("place").alias("a"), (start_of("place") + count + WINDOW - 1).alias("b"))
    kinds = written(passages.groupBy("fp").agg(F.count("*").alias("passages")).where("passages > 1"), "mixed-fingerprints")
    several = passages.join(kinds, "fp").select("fp", "passages", F.col("first.doc_id").alias("doc_id"), F.col("first.place").alias("place"))
    return equal, several


def fields(column: pa.ListArray) -> list[np.ndarray]:
    """The fields of a column of lists of structs of integers, end to end; null lists count as empty."""
    flat = column.flatten()
    return [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(flat.type.num_fields)]


def list_ends(column: pa.ListArray) -> list[int]:
    """Where each list ends in the flattened column."""
    return np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float))).astype(int).tolist()


def with_words(docs: DataFrame, several: DataFrame) -> DataFrame:
    """fp, passages, doc_id, place (tag and first window) and word hashes of the given passages."""
    wanted = several.groupBy("doc_id", tag_of("place").alias("tag")).agg(F.collect_list(F.struct("fp", "passages", "place")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            fps, passages, places, ends = *fields(batch.column(2)), list_ends(batch.column(2))
            out, at = [[], [], [], [], []], 0
            for doc_id, text, end in zip(ids, texts, ends):
                words = signed(word_hashes((text or "").encode())[0])
                start = places[at:end] >> COUNT_BITS
                first = start & ((1 << START_BITS) - 1)
                last = first + (places[at:end] & ((1 << COUNT_BITS) - 1)) + WINDOW
                ok = np.flatnonzero(last <= len(words))
                for column, values in zip(out, (fps[at:end][ok], passages[at:end][ok], np.full(len(ok), doc_id), start[ok], [words[a:b] for a, b in zip(first[ok], last[ok])])):
                    column.extend(values)
                at = end
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["fp", "passages", "doc_id", "start", "words"])

    # rows equal in id and text are one document
    return docs.join(wanted, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]).select("doc_id", "text", "wanted").mapInArrow(run, "fp long, passages long, doc_id long, start long, words array<long>")


def by_automata(passages: DataFrame) -> DataFrame:
    """doc_id, tag and first word of every window that also starts earlier, for passages that share a fingerprint with others."""
    parts = F.ceil(F.col("passages") / SHARD_PASSAGES)
    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in slices(batches, 2_000):
            rows, out = zip(*(batch.column(k).to_pylist() for k in range(5))), []
            for fp, shard, doc, start, words in rows:
                if (fp, shard) != key:
                    out += first_windows(group)
                    key, group = (fp, shard), []
                group.append((doc, start, words))
            yield table(out)
        yield table(first_windows(group))

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["window", "doc_id", "start", "first_doc", "first_start"])

    sorted_ = dealt.select("fp", "shard", "doc_id", "start", "words").repartition("fp", "shard").sortWithinPartitions("fp", "shard", "doc_id", "start")
    windows = written(sorted_.mapInArrow(run, "window long, doc_id long, start long, first_doc long, first_start long"), "windows")
    least = written(windows.groupBy("window").agg(F.min(F.struct("first_doc", "first_start")).alias("least"), F.count("*").alias("n")).where("n > 1").select("window", "least"), "first-windows")
    later = windows.join(least, "window").where(F.struct(F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start")) != F.col("least"))
    place = F.shiftleft("start", COUNT_BITS)
    return later.select("doc_id", tag_of(place).alias("tag"), start_of(place).alias("a"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, tag and spans (first and last word, ends inclusive) to be removed."""
    equal, several = settled(docs)
    windows = by_automata(with_words(docs, several))
    spans = equal.union(windows.select("doc_id", "tag", "a", (F.col("a") + WINDOW - 1).alias("b")))
    return spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document with an id, and its removed word spans."""
    tag = F.xxhash64("text").bitwiseAND(F.lit((1 << TAG_BITS) - 1)).cast("int")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), "text").where("doc_id IS NOT NULL")
    spans = removed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, at = [], 0
            firsts, lasts = fields(batch.column(2))
            for text, end in zip(batch.column(1).to_pylist(), list_ends(batch.column(2))):
                words = (text or "").encode().split()  # of bytes: at space and tab to carriage return alone
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(steps, firsts[at:end], 1)
                np.add.at(steps, lasts[at:end] + 1, -1)
                gone = np.cumsum(steps)[:-1] > 0
                kept = [words[i] for i in np.flatnonzero(~gone)]
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                merged = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).tolist()
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), merged))
                at = end
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    joined = docs.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")


ORACLE = """
WITH words AS (
    SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
grams AS (
    SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS s, w FROM words),
keyed AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS k FROM grams),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM keyed) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
    FROM places LEFT JOIN covered USING (doc_id, p) WHERE covered.p IS NULL GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
