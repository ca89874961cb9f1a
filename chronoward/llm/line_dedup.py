"""Fuzzy line deduplication by MinHash over character shingles.

A line's shingles are runs of five characters (the whole line, if shorter). Minimum hashes in bands propose links, the
exact Jaccard similarity of the shingle sets confirms them (0.8 or more; pairs that a bound from above excludes are not compared), and a distributed union-find keeps the first
line (by document id, then position) of every component. Equal lines are folded together before that. Within a bucket
lines are compared with the first of their task, those with the first of all, and then all that are still in different
components with each other.

Blank lines are never removed and belong to no component. A null text has no lines and stays null; a document of which
every line goes keeps an empty text. Rows that share a document id are told apart, and ordered, by a hash of their text;
rows equal in both share their decisions. Rows without an id take no part and keep their lines. An empty table gives an empty
result. Other columns are carried along by `deduplicated` and not read elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BASE, dropped, mix, signed, slices, sorted_set, written
from .components import components
from .crossing import crossing_links
from .sieve import bits_of, ends, passes, sieved

SIZE, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 5
#: Groups of shingles in a line's outline.
MARKS = 64
#: Lines whose hashes a task remembers, to sketch equal ones once; lines whose buckets a task folds at once.
SEEN, FOLDED = 1_000_000, 400_000
#: Lines of a band that meet in a cell, pairs in a pack.
IN_CELL, PACK = 200_000, 50_000
#: Columns of band hashes, two in each.
BAND_NAMES = [f"b{i}" for i in range(BANDS // 2)]
#: Odd factors of 32 bits: products of that width are fast, and a collision costs a comparison.
MULTIPLIERS = np.array([int(x) >> 32 | 1 for x in mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))], dtype=np.uint32)


def mix_short(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser (multiply and shift), applied to every element."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def grams(lines: list[str], kind=np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all lines in one array, and where each line's begin and end (every line has at least one character).

    Between two lines stand hashes that belong to none. Hashes of 64 bits tell shingles apart; those of 32 bits are faster and will do for
    sketches.
    """
    gap = "\0" * (SIZE - 1)
    codes = np.frombuffer((gap.join(lines) + gap).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(kind) + kind(1)
    lengths = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + SIZE - 1)])
    base, whole = kind(int(BASE) & np.iinfo(kind).max), len(codes) - SIZE + 1
    gram = codes[SIZE - 1 :].copy()
    for k in range(SIZE - 2, -1, -1):
        gram *= base
        gram += codes[k : whole + k]
    gram = (mix if kind is np.uint64 else mix_short)(gram)
    # a line shorter than a shingle is its own single shingle
    for i in np.flatnonzero(lengths < SIZE):
        gram[starts[i] : starts[i] + lengths[i] + SIZE - 1] = int.from_bytes(hashlib.blake2b(lines[i].encode("utf-8", "surrogatepass"), digest_size=kind().itemsize).digest(), "little")
    return gram, starts, starts + np.maximum(lengths - SIZE + 1, 1)


def shingle_hashes(lines: list[str], kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines one after another, and where each line's begin."""
    gram, starts, ends = grams(lines, kind)
    counts = ends - starts
    begin = np.concatenate([[0], np.cumsum(counts[:-1])])
    return gram[np.arange(counts.sum()) + np.repeat(starts - begin, counts)], begin


def shingles(line: str) -> set[str]:
    return {line[i : i + SIZE] for i in range(max(len(line) - SIZE + 1, 1))}


def minima(lines: list[str]) -> np.ndarray:
    """The minimum hashes of every line, one row each."""
    hashes, starts, ends = grams(lines, np.uint32)
    # the hashes between two lines become repeats of the first one's first shingle, which change no minimum
    hashes, after, gap = hashes[: ends[-1]], np.flatnonzero(np.diff(starts, append=0) > 2 * SIZE - 2), 2 * (SIZE - 1)
    hashes[(ends[after, None] + np.arange(gap)).ravel()] = np.repeat(hashes[starts[after]], gap)
    product, least = np.empty_like(hashes), np.empty((len(MULTIPLIERS), len(lines)), dtype=np.uint32)
    for k, m in enumerate(MULTIPLIERS):
        np.minimum.reduceat(np.multiply(hashes, m, out=product), starts, out=least[k])
    return least.T.astype(np.uint64)


def outlines(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of each line fall into each of MARKS groups, and at least how many different ones it has.

    Two lines share at most the sum, over the groups, of the smaller number; so outlines bound their similarity from above. Lines with more than
    255 in a group have an outline that bounds nothing.
    """
    hashes, begin = shingle_hashes(lines, np.uint32)
    n, lengths = len(lines), np.diff(np.append(begin, len(hashes)))
    groups = np.repeat(np.arange(n, dtype=np.int64) * MARKS, lengths) + (hashes % np.uint32(MARKS)).astype(np.int64)
    counts = np.bincount(groups, minlength=n * MARKS).reshape(n, MARKS)
    keys = np.sort(np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), lengths) | hashes)
    sizes = np.add.reduceat(np.append(True, keys[1:] != keys[:-1]), begin, dtype=np.int64)
    sizes[(counts > 255).any(axis=1)] = 0
    counts[sizes == 0] = 255
    return counts.astype(np.uint8), sizes


def band_hashes(lines: list[str]) -> np.ndarray:
    """Hashes of 32 bits for each band, two to a column: strangers that share one cost a comparison, no more."""
    least = minima(lines).reshape(len(lines), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(lines), BANDS))
    for r in range(ROWS):
        key = mix(key ^ least[:, :, r]) + np.uint64(r)
    key = key >> np.uint64(32)
    return signed((key[:, ::2] << np.uint64(32)) | key[:, 1::2])


def split_lines(text: str) -> list[tuple[int, str]]:
    """Position and content of the lines that are not blank."""
    return [(i, x) for i, x in enumerate(text.split("\n")) if x and not x.isspace()]


def chunks(rows, most: int = 60_000, width=lambda r: len(r[-1])):
    """Consecutive rows (…, line) of about `most` characters together, so that their hashes stay in a core's cache; `width` gives the characters of other rows."""
    group, size = [], 0
    for r in rows:
        group.append(r)
        size += width(r)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, tag, pos, two hashes and band hashes (b0, b1, ...) of every line that is not blank.

    Of equal lines that a task sees, the first alone has band hashes. Every document has a row of its own besides, whose pos is -1 less its
    number of lines.
    """
    names = ["doc_id", "tag", "pos", "h1", "h2", *BAND_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 1_000):
            ids, tags, texts = (batch.column(k).to_pylist() for k in range(3))
            n_lines = pa.array([-1 if t is None else -2 - t.count("\n") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_lines, *[pa.nulls(len(ids), pa.int64())] * (len(names) - 3)], names)
            rows = ((d, g, i, x) for d, g, t in zip(ids, tags, texts) if t for i, x in split_lines(t))
            for group in chunks(rows):
                lines = [r[3] for r in group]
                same = digests(lines)
                new = []
                for i, h in enumerate(same[:, 0].tolist()):
                    if h not in seen:
                        seen.add(h)
                        new.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                at = np.full(len(lines), -1)
                at[new] = np.arange(len(new))
                bands = pa.array(at, mask=at < 0)
                found = band_hashes([lines[i] for i in new]) if new else np.zeros((0, BANDS // 2), dtype=np.int64)
                columns = [*(np.array([r[k] for r in group], dtype=np.int64) for k in range(3)), same[:, 0], same[:, 1]]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), *(pa.array(np.ascontiguousarray(c)).take(bands) for c in found.T)], names)

    return docs.select("doc_id", "tag", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def packed(x: np.ndarray) -> bytes:
    """Integers as compressed bytes, those of one rank together: ranks that hardly change take next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def dealt(distinct: DataFrame, cells: int) -> DataFrame:
    """Packs of a cell's buckets: differences of sorted band hashes, and the first line of each bucket in a task (a is null), or buckets, b and a.

    A bucket that holds a large share of all lines thus sends one line of each task to its cell. The task's other lines of it are pairs with
    that one already (a), and their packs go to any cell. Every band has `cells` cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FOLDED:
                yield from fold(pa.Table.from_batches(held), number)
                held, size, number = [], 0, number + 7
        if size:
            yield from fold(pa.Table.from_batches(held), number)

    def fold(lines: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        place = lines.column("place").to_numpy()
        for k in range(BANDS):
            two = lines.column(BAND_NAMES[k // 2]).to_numpy().view(np.uint64)
            band = (two if k % 2 else two >> np.uint64(32)).astype(np.uint32)  # the lower and the upper half
            order = np.argsort(band, kind="stable")
            band, ordered = band[order], place[order]
            begins = np.concatenate([[True], band[1:] != band[:-1]])
            first = ordered[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
            packs = []
            keys, ids = band[begins], ordered[begins]
            ends = np.searchsorted((keys.astype(np.uint64) * np.uint64(cells)) >> np.uint64(32), np.arange(cells), side="right").tolist()
            for c, (i, j) in enumerate(zip([0, *ends], ends)):
                if i < j:
                    packs.append((k * cells + c, packed(np.diff(keys[i:j], prepend=np.uint32(0))), packed(ids[i:j]), None))
            other = np.flatnonzero(~begins)
            for n, part in enumerate(np.split(other, range(PACK, len(other), PACK)) if len(other) else []):
                bucket = (np.int64(k) << np.int64(32)) | band[part].astype(np.int64)
                packs.append(((number * BANDS + k + 31 * n) % (BANDS * cells), packed(bucket), packed(ordered[part]), packed(first[part])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*packs), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["cell", "buckets", "b", "a"])

    return distinct.select("place", *BAND_NAMES).mapInArrow(run, "cell long, buckets binary, b binary, a binary")


def bucket_pairs(distinct: DataFrame, n: int) -> DataFrame:
    """bucket, a and b: every line of a bucket with the first one of its task, and those with the first of all."""
    cells = 1 + n // IN_CELL + min(7, n // 10_000)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        cell, out = key[0].as_py(), []
        keys, ids = [], []
        for buckets, b, a in zip(*(table.column(c).to_pylist() for c in ("buckets", "b", "a"))):
            if a is None:
                keys.append(np.cumsum(unpacked(buckets, np.uint32), dtype=np.uint32))
                ids.append(unpacked(b, np.int64))
            else:
                out.append((unpacked(buckets, np.int64), unpacked(a, np.int64), unpacked(b, np.int64)))
        if keys:
            keys, ids = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            begins = np.concatenate([[True], keys[1:] != keys[:-1]])
            first = ids[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
            out.append((((np.int64(cell // cells) << np.int64(32)) | keys.astype(np.int64))[~begins], first[~begins], ids[~begins]))
        return pa.table([np.concatenate(c) for c in zip(*out)], ["bucket", "a", "b"])

    return dealt(distinct, cells).groupBy("cell").applyInArrow(meet, "bucket long, a long, b long")


def digests(lines: list[str]) -> np.ndarray:
    """128 bits of each line's content, as a row of two integers."""
    return np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines), dtype=np.int64).reshape(-1, 2)


def line_texts(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """place, content and outline of the wanted lines (place, h1, h2; `n` of them). Other lines stay in their task, but for a few."""
    sent = bits_of(wanted.select("h1"), n)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = np.frombuffer(sent.value, dtype=np.uint8), set()
        for batch in slices(batches, 1_000):
            for group in chunks((x,) for t in batch.column(0).to_pylist() if t for _, x in split_lines(t)):
                same = digests([x for x, in group])
                keep = []
                for i in np.flatnonzero(passes(np.ascontiguousarray(same[:, 0]), bitmap)).tolist():
                    h = same[i].tobytes()
                    if h not in seen:
                        seen.add(h)
                        keep.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in same[keep].T), pa.array([group[i][0] for i in keep], pa.string())], ["h1", "h2", "line"])

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            for group in chunks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                marks, sizes = outlines([x for _, x in group])
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in group], pa.int64()), pa.array([x for _, x in group], pa.string()), pa.array([r.tobytes() for r in marks], pa.binary()), pa.array(sizes, pa.int64())], ["place", "line", "marks", "size"])

    lines = docs.select("text").mapInArrow(found, "h1 long, h2 long, line string")
    return wanted.join(lines, ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("place", "line").mapInArrow(outlined, "place long, line string, marks binary, size long")


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) like `roots`, after more links (a, b): components of the few roots that these connect, in place of all ids."""
    of = lambda x: roots.toDF(x, f"root_{x}")
    own = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))
    own = written(own, "lines-root-links")
    # ids that no link had before are their own roots
    known = roots.union(own.where("a = root_a").select("a", "root_a")).union(own.where("b = root_b").select("b", "root_b")).distinct()
    above = components(own.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).toDF("root", "top")
    return written(known.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "lines-roots")


def removed_lines(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """doc_id, tag and pos of every line to be removed, of documents whose lines have these sketches (deleted here)."""
    # equal lines have equal bands, so any of them will do
    distinct = sketches.where("pos >= 0").groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.max(b).alias(b) for b in BAND_NAMES])
    distinct = written(distinct.withColumn("place", F.monotonically_increasing_id()), "lines-distinct", n=F.count("*"))
    n = distinct.measured["n"]
    lines = written(sketches.where("pos >= 0").select("doc_id", "tag", "pos", "h1", "h2"), "lines-places")
    dropped(sketches)
    pairs = written(bucket_pairs(distinct, n), "lines-pairs")
    bands, distinct = distinct, written(distinct.select("place", "h1", "h2", "n"), "lines-contents")
    dropped(bands)
    star = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "lines-star", n=F.count("*"))
    wanted = written(sieved(distinct.select("place", "h1", "h2"), "place", ends(star), star.measured["n"]), "lines-wanted", n=F.count("*"))
    sets = written(line_texts(docs, wanted, wanted.measured["n"]), "lines-texts")
    links = written(verified(star, sets), "lines-links")
    roots = components(links)
    # buckets in which the first lines did not reach all: compare all that are still in different components
    member = pairs.select("bucket", F.explode(F.array("a", "b")).alias("id")).distinct()
    new = written(
        crossing_links(
            member, roots, sets.select("place", "line"), lambda found, _: verified(found.join(star, ["a", "b"], "left_anti"), sets), line_sets, SIMILARITY,
            spanning=True, narrowed=lambda content, ids, n: sieved(content, "place", ids, n),
        ),
        "lines-links", n=F.count("*"),
    )
    if new.measured["n"]:
        roots = joined_roots(roots, new)
    dropped(sets)
    # every line that has a copy or a near one, with its group, of which the first line stays
    linked = distinct.where("n > 1").union(sieved(distinct.where("n = 1"), "place", roots.select("id"), wanted.measured["n"]))
    grouped = linked.join(roots.withColumnRenamed("id", "place"), "place", "left").where("n > 1 OR root IS NOT NULL")
    grouped = written(grouped.select("h1", "h2", F.coalesce("root", "place").alias("root")), "lines-grouped", n=F.count("*"))
    here = sieved(lines.select("doc_id", "tag", "pos", "h1", "h2"), "h1", grouped.select("h1"), grouped.measured["n"])
    members = written(here.join(grouped, ["h1", "h2"]).drop("h1", "h2"), "lines-groups")
    here = F.struct("doc_id", "tag", "pos")
    first = written(members.groupBy("root").agg(F.min(here).alias("first")), "lines-first")
    return members.join(first, "root").where(here != F.col("first")).select("doc_id", "tag", "pos")


def hashed_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted set of the 64-bit hashes of every line's shingles."""
    hashes, begin = shingle_hashes(lines)
    return [sorted_set(h) for h in np.split(hashes, begin[1:])]


def line_sets(lines: pa.ChunkedArray) -> list[np.ndarray]:
    return hashed_sets(lines.to_pylist())


def possible(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) whose outlines allow a similarity of SIMILARITY: no pair that has it is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            together = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            most = np.minimum(left, right).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(most >= (together - most) * SIMILARITY - 1e-6)))

    of = lines.select("place", "marks", "size")
    both = pairs.join(of.toDF("a", "of_a", "size_a"), "a").join(of.toDF("b", "of_b", "size_b"), "b")
    return both.select("a", "b", "of_a", "of_b", "size_a", "size_b").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least SIMILARITY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            keep = []
            pairs = zip(range(batch.num_rows), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for group in chunks(pairs, 300_000, width=lambda r: len(r[1]) + len(r[2])):
                lines = list({x for r in group for x in r[1:]})
                sets = dict(zip(lines, hashed_sets(lines)))
                for i, x, y in group:
                    x, y = sets[x], sets[y]
                    if min(len(x), len(y)) >= max(len(x), len(y)) * SIMILARITY:
                        both = np.sort(np.concatenate([x, y]))
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        if shared >= (len(x) + len(y) - shared) * SIMILARITY:
                            keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    near = written(possible(pairs, lines), "lines-possible", n=F.count("*"))
    of = sieved(lines.select("place", "line"), "place", ends(near), 2 * near.measured["n"])
    joined = near.join(of.toDF("a", "of_a"), "a").join(of.toDF("b", "of_b"), "b")
    return joined.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long").distinct()


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text of the rows with an id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").withColumn("tag", F.xxhash64("text"))


def gone_lines(plain: DataFrame, sketches: DataFrame) -> DataFrame:
    """id, tag and the sorted positions of the removed lines, for documents that lose one."""
    return removed_lines(plain, sketches).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def decided(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the positions (from 0) of the removed lines of every document with an id."""
    plain = tagged(docs)
    sketches = written(sketched(plain), "lines")
    own = written(sketches.where("pos < 0").select("doc_id", "tag", (-1 - F.col("pos")).alias("n_lines")), "lines-numbers")
    joined = own.join(gone_lines(plain, sketches), ["doc_id", "tag"], "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("gone", F.array().cast("array<long>")).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with their kept lines as text, and n_chars to match where there is one; columns as they came, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("tag"))
    plain = tagged(docs)
    joined = rows.join(gone_lines(plain, written(sketched(plain), "lines")), ["doc_id", "tag"], "left").select("row", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            row = batch.column(0)
            names, columns = [f.name for f in row.type], row.flatten()
            at = names.index("text")
            texts = columns[at].to_pylist()
            for k, places in enumerate(batch.column(1).to_pylist()):
                if places and texts[k] is not None:
                    drop = set(places)
                    texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in drop)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    result = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark.read.parquet(f"{sf_dir}/documents.parquet"))
