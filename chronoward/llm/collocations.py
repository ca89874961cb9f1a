"""Phrase collocations: n-grams as rows, counts per language, exact scores, longest phrases, ranks.

A text is lower-cased (A to Z only) and cut at `. , ; : ! ?` and line ends into pieces, these at spaces and tabs into words. Runs of one
to `most_words` words within a piece are exploded into rows, counted per language by hash aggregation, joined with the counts of
their first and last parts, scored in whole decimals, dropped where a phrase that is one word longer occurs about as often
(anti-join), and ranked by a window.

Only phrases seen `least` times or more and their parts matter, and every part of such a phrase is at least as frequent.
So the runs of n words are exploded level by level, and only where both runs of n - 1 words inside are frequent: nothing that
could count is lost. Tasks look that up in a filter of hashed bits, whose size is bounded; what it lets through wrongly
is counted and then dropped for being rare. From three words on most such runs are rare. They are first counted in hashed cells, all
that share a cell together, and are exploded only where their cell holds as many as a frequent run needs: a cell holds
at least what each of its runs does. A row holds its words as 64-bit numbers, and a task counts equal rows of a block of text before
they leave. The table of words shows whether two words of a language share a number; another seed is taken if so, so counts are exact.

Defined results. A null text counts as empty, a null language as `und`. Repeated rows are texts of their own. Texts of white space,
punctuation alone and empty tables give no phrase. Of cuts with the lowest score (rounded down) the one with the shortest
first part counts; phrases equal in score and frequency are ranked by the bytes of their text. Columns other than
`text` and `lang` are not read. Long texts are read in blocks that end between pieces; a piece without any end is read as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import mix, prefix_hashes, range_hashes, signed, table, written

#: Bytes of text that a task holds as arrays, rows that it gathers, bits of a filter for each phrase, and its least and most bits.
BLOCK, GATHERED, BITS, LEAST_BITS, MOST_BITS = 1 << 20, 150_000, 16, 1 << 16, 1 << 27
#: Cells for as many runs as make one frequent, and the least and most number of cells.
CELLS, LEAST_CELLS, MOST_CELLS = 10, 1 << 16, 1 << 26
#: Phrases of a language that one task ranks.
RANKED = 100_000
#: Bytes of a filter that one row carries.
PAGE = 1 << 13
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10)
STEP = np.uint64(0xD1342543DE82EF95)


def seed_of(lang: str, salt: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{salt} {lang}".encode(), digest_size=8).digest(), "little"))


def words_of(data: bytes, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, start and end of every word of lower-cased text, and whether the next word is in the same piece."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = (raw != 32) & (raw != 9) & (raw != 10)
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends, np.zeros(0, dtype=bool)
    letters = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * salt))
    hashes = range_hashes(prefix_hashes(letters[raw]), starts, ends)
    joined = np.zeros(len(starts), dtype=bool)
    joined[:-1] = raw[ends[:-1]] != 10
    wide = np.flatnonzero(joined[:-1] & (starts[1:] - ends[:-1] > 1))
    if len(wide):
        breaks = np.flatnonzero(raw == 10)
        joined[wide] = np.searchsorted(breaks, ends[wide]) == np.searchsorted(breaks, starts[wide + 1])
    return hashes, starts, ends, joined


def runs(hashes: np.ndarray, joined: np.ndarray, size: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit mark of the run of `size` words at every word, and whether the run lies in one piece."""
    n = max(len(hashes) - size + 1, 0)
    mark, whole = mix(hashes[:n] ^ seed), np.ones(n, dtype=bool)
    for i in range(1, size):
        mark = mix(mark * STEP + hashes[i : i + n])
        whole &= joined[i - 1 : i - 1 + n]
    return mark, whole


def probes(mark: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.uint64(bits - 1)
    return mark & m, (mark >> np.uint64(20)) * STEP & m, mix(mark) & m


def holds(bitmap: np.ndarray, mark: np.ndarray) -> np.ndarray:
    out = np.ones(len(mark), dtype=bool)
    for at in probes(mark, 8 * len(bitmap)):
        out &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and lower-cased text in blocks that end between pieces."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            data = text.as_py().translate(LOWER)
            while len(data) > BLOCK and (cut := data.rfind(b"\n", 0, BLOCK) + 1 or data.find(b"\n") + 1):
                yield lang, data[:cut]
                data = data[cut:]
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            total += len(data)
            if sizes[lang] >= BLOCK:
                yield lang, b"\n".join(held.pop(lang))
                total -= sizes.pop(lang)
            elif total >= 2 * BLOCK:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, sizes, total = {}, {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def counted_rows(mark: np.ndarray, columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns, count and a place of the distinct rows; rows meet by their mark and are told apart by all their columns."""
    order = np.argsort(mark, kind="stable")
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return [c[first] for c in columns], n, order[first]


class Gathered:
    """Counted rows of a language, gathered over the blocks of a task, so that what repeats leaves it once for many blocks."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, mark: np.ndarray, columns: list[np.ndarray]) -> bool:
        """Adds a block's rows; whether it is time to send them."""
        columns, n, at = counted_rows(mark, columns)
        self.parts.append((mark[at], columns, n))
        self.rows += len(n)
        if self.rows >= GATHERED and len(self.parts) > 1:
            self.merge()
        return self.rows >= GATHERED

    def merge(self) -> tuple[list[np.ndarray], np.ndarray]:
        mark = np.concatenate([p[0] for p in self.parts])
        columns = [np.concatenate(c) for c in zip(*(p[1] for p in self.parts))]
        columns, n, at = counted_rows(mark, columns, np.concatenate([p[2] for p in self.parts]))
        self.parts, self.rows = [(mark[at], columns, n)], len(n)
        return columns, n


def word_rows(docs: DataFrame, salt: int) -> DataFrame:
    """lang, word, its number and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in blocks(batches):
            hashes, starts, ends, _ = words_of(data, salt)
            (h,), n, at = counted_rows(hashes, [hashes])
            words = [data[starts[i] : ends[i]].decode() for i in at]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "word": pa.array(words, pa.string()), "w1": pa.array(signed(h)), "n": pa.array(n, pa.int64())})

    return docs.mapInArrow(run, "lang string, word string, w1 long, n long").groupBy("lang", "word", "w1").agg(F.sum("n").alias("n"))


def candidates(data: bytes, lang: str, size: int, salt: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of a block, the places of runs of `size` words in which both shorter runs are in the filter, their marks."""
    hashes, _, _, joined = words_of(data, salt)
    shorter, whole = runs(hashes, joined, size - 1, seed_of(lang, salt))
    good = np.flatnonzero(whole)
    good = good[holds(bitmap, shorter[good])]
    follows = np.zeros(len(hashes) + 1, dtype=bool)
    follows[good] = True
    at = good[follows[good + 1] & joined[good]]
    return hashes, at, mix(shorter[at] * STEP + hashes[at + size - 1])


def cell_of(mark: np.ndarray, cells: int) -> np.ndarray:
    return (mark >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def full_cells(docs: DataFrame, size: int, salt: int, frequent, least: int, cells: int) -> bytes:
    """Bits of the cells that hold `least` runs or more. Tasks send pages of counts, equal pages are added; the driver gets bits alone."""
    page, kind = min(PAGE, cells), np.uint8 if least < 256 else np.uint32  # a task counts to `least` and no further

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, counts = np.frombuffer(frequent.value, dtype=np.uint8), np.zeros(cells, dtype=kind)
        for lang, data in blocks(batches):
            at, n = np.unique(cell_of(candidates(data, lang, size, salt, bitmap)[2], cells), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, least)
        pages = counts.reshape(-1, page)
        some = np.flatnonzero(pages.any(axis=1))
        for i in range(0, len(some), 256):
            yield pa.RecordBatch.from_pydict({"page": pa.array(some[i : i + 256], pa.int64()), "counts": pa.array([pages[k].tobytes() for k in some[i : i + 256]], pa.binary())})

    def add(key: tuple, batches: pa.Table) -> pa.Table:
        out = np.zeros(page, dtype=np.int64)
        for b in batches.column("counts"):
            out += np.frombuffer(b.as_py(), dtype=kind)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(out >= least, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((cells // page, page // 8), dtype=np.uint8)
    for row in docs.mapInArrow(run, "page long, counts binary").groupBy("page").applyInArrow(add, "page long, bits binary").toLocalIterator():  # at most MOST_CELLS / 8 bytes in all
        out[row["page"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.tobytes()


def run_rows(docs: DataFrame, size: int, salt: int, frequent, full=None) -> DataFrame:
    """lang, the numbers of `size` words and how often they stand together, wherever both shorter runs are in the filter (and the cell is full)."""
    names = [f"w{i + 1}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(frequent.value, dtype=np.uint8)
        cells = np.frombuffer(full.value, dtype=np.uint8) if full else None
        held: dict[str, Gathered] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            columns, n = held.pop(lang).merge()
            for i in range(0, len(n), 100_000):
                k = len(n[i : i + 100_000])
                yield pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, k)} | {name: pa.array(signed(c[i : i + k])) for name, c in zip(names, columns)} | {"n": pa.array(n[i : i + k], pa.int64())})

        for lang, data in blocks(batches):
            hashes, at, mark = candidates(data, lang, size, salt, bitmap)
            if full:
                cell = cell_of(mark, 8 * len(cells))
                keep = (cells[cell >> 3] >> (cell & 7).astype(np.uint8) & np.uint8(1)).astype(bool)
                at, mark = at[keep], mark[keep]
            if not len(at):
                continue
            if held.setdefault(lang, Gathered()).add(mark, [hashes[at + i] for i in range(size)]):
                yield from out(lang)
            while sum(g.rows for g in held.values()) > 3 * GATHERED:
                yield from out(max(held, key=lambda k: held[k].rows))
        for lang in list(held):
            yield from out(lang)

    kind = ", ".join(f"{k} long" for k in names)
    return docs.mapInArrow(run, f"lang string, {kind}, n long").groupBy("lang", *names).agg(F.sum("n").alias("n"))


def filter_of(frequent: DataFrame, rows: int, size: int, salt: int) -> bytes:
    """A filter of hashed bits over the runs of a table. Tasks send pages of bits, equal pages meet; the driver gets the bits alone."""
    bits = min(max(1 << (BITS * rows).bit_length(), LEAST_BITS), MOST_BITS)
    names = [f"w{i + 1}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits, dtype=bool)
        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            columns = [batch.column(k).to_numpy().view(np.uint64) for k in names]
            for lang in set(langs):
                own = np.flatnonzero(langs == lang)
                mark = runs(np.stack([c[own] for c in columns], axis=1).reshape(-1), np.ones(len(own) * size, dtype=bool), size, seed_of(lang, salt))[0][::size]
                for at in probes(mark, bits):
                    bitmap[at] = True
        pages = np.packbits(bitmap, bitorder="little").reshape(-1, min(PAGE, bits // 8))
        some = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_pydict({"page": pa.array(some, pa.int64()), "bits": pa.array([pages[i].tobytes() for i in some], pa.binary())})

    def meet(key: tuple, batches: pa.Table) -> pa.Table:
        out = np.zeros(min(PAGE, bits // 8), dtype=np.uint8)
        for b in batches.column("bits"):
            out |= np.frombuffer(b.as_py(), dtype=np.uint8)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    tasks = max(1, min(64, -(-rows // 200_000)))
    found = frequent.select("lang", *names).repartition(tasks).mapInArrow(run, "page long, bits binary").groupBy("page").applyInArrow(meet, "page long, bits binary")
    out = np.zeros((-(-bits // 8 // PAGE) or 1, min(PAGE, bits // 8)), dtype=np.uint8)
    for row in found.toLocalIterator():  # at most MOST_BITS / 8 bytes in all
        out[row["page"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.tobytes()


def frequent_runs(docs: DataFrame, most_words: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of the frequent words (lang, w1, word), frequent runs of every size (lang, g, n), words of every language (lang, total)."""
    spark = docs.sparkSession
    for salt in range(8):
        words = written(word_rows(docs, salt), "colloc-words")
        if not words.groupBy("lang", "w1").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
            break
    else:
        raise RuntimeError("words share numbers under every seed")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    now = written(words.where(F.col("n") >= least), "colloc-1", rows=F.count("*"))
    names = now.select("lang", "w1", "word")
    levels = [now.select("lang", F.array("w1").alias("g"), "n")]
    for size in range(2, most_words + 1):
        if not now.measured["rows"]:
            break
        bits = spark.sparkContext.broadcast(filter_of(now, now.measured["rows"], size - 1, salt))
        full = None
        if size > 2:  # no more runs of this size than of the frequent ones that begin them
            cells = min(max(1 << (CELLS * now.measured["n"] // max(least, 1)).bit_length(), LEAST_CELLS), MOST_CELLS)
            full = spark.sparkContext.broadcast(full_cells(docs, size, salt, bits, least, cells))
        now = written(run_rows(docs, size, salt, bits, full).where(F.col("n") >= least), f"colloc-{size}", rows=F.count("*"), n=F.sum("n"))
        for sent in (bits, *([full] if full else [])):
            sent.unpersist()
        levels.append(now.select("lang", F.array(*[f"w{i + 1}" for i in range(size)]).alias("g"), "n"))
    every = levels[0]
    for more in levels[1:]:
        every = every.union(more)
    return names, every, totals


def phrases(docs: DataFrame, most_words: int = 5, least: int = 100, share: int = 100, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `first` phrases of every language.

    A phrase is dropped if it lies in a longer one with at least `share` percent of its frequency.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names, every, totals = frequent_runs(docs, most_words, least)
    several = every.where(F.size("g") > 1)
    # a longer phrase as frequent as that implies one that is a single word longer and as frequent
    longer = every.where(F.size("g") > 2).select("lang", F.explode(F.array(F.expr("slice(g, 1, size(g) - 1)"), F.expr("slice(g, 2, size(g) - 1)"))).alias("g"), "n")
    longer = longer.groupBy("lang", "g").agg(F.max("n").alias("n_longer")).toDF("lang_", "g_", "n_longer")
    kept = several.join(longer, (F.col("lang") == F.col("lang_")) & (F.col("g") == F.col("g_")) & (F.col("n_longer") * 100 >= F.col("n") * share), "left_anti")
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size(g) - 1)")))
    cuts = cuts.select("lang", "g", F.col("n").alias("a"), "k", F.expr("slice(g, 1, k)").alias("g1"), F.expr("slice(g, k + 1, size(g) - k)").alias("g2"))
    cuts = cuts.join(every.toDF("lang", "g1", "l"), ["lang", "g1"]).join(every.toDF("lang", "g2", "r"), ["lang", "g2"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.withColumn("top", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("total")).withColumn("under", whole("l") * whole("r"))
    scored = scored.withColumn("score", F.expr("top div under"))
    best = scored.groupBy("lang", "g", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    named = best.select("lang", "g", "a", F.col("total").alias("n"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.lit("").alias("phrase"))
    for i in range(most_words):
        word = names.select(F.col("lang").alias("lang_"), F.col("w1").alias("w_"), "word")
        named = named.withColumn("w", F.get("g", F.lit(i))).join(word, (F.col("lang") == F.col("lang_")) & (F.col("w") == F.col("w_")), "left")
        named = named.withColumn("phrase", F.when(F.col("w").isNull(), F.col("phrase")).when(F.lit(i == 0), F.col("word")).otherwise(F.concat("phrase", F.lit(" "), "word"))).drop("w", "lang_", "w_", "word")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    named = written(named, "colloc-named", rows=F.count("*"))
    while named.measured["rows"] > max(RANKED, 4 * first):  # parts of a language first, and then what is among the first of its part
        rows = named.measured["rows"]
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("g", F.lit(rows)), F.lit(-(-rows // max(RANKED, 4 * first)) + 1))).orderBy(*order)
        named = written(named.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= first).drop("rank"), "colloc-named", rows=F.count("*"))
        if named.measured["rows"] == rows:
            break
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, unnest([w[i : i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g FROM words, range(1, 6) t(k)),
counts AS (SELECT lang, g, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM counts WHERE len(g) = 1 GROUP BY 1),
several AS (SELECT lang, g, n AS a FROM counts WHERE len(g) > 1 AND n >= 100),
cuts AS (
    SELECT s.lang, s.g, s.a, k, l.n AS l, r.n AS r, t.total AS n, CAST(1000 * s.a::HUGEINT * t.total // (l.n::HUGEINT * r.n) AS BIGINT) AS score
    FROM several s JOIN range(1, 5) c(k) ON k < len(s.g) JOIN totals t USING (lang)
    JOIN counts l ON l.lang = s.lang AND l.g = s.g[1 : k] JOIN counts r ON r.lang = s.lang AND r.g = s.g[k + 1 : len(s.g)]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
kept AS (
    SELECT b.* FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM several x WHERE x.lang = b.lang AND len(x.g) > len(b.g) AND 100 * x.a >= 100 * b.a
          AND contains(' ' || array_to_string(x.g, ' ') || ' ', ' ' || array_to_string(b.g, ' ') || ' '))),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
