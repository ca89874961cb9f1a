"""Language identification by interpolated Kneser-Ney character models.

Four-character sequences of the learning rows are counted per language inside each partition and summed by Spark; the
continuation counts of the shorter orders follow from the distinct longer ones. Discounts, context totals and smoothed
probabilities are computed by Spark from all counts, however many there are, and kept as tables: a row for each sequence
with its log probabilities in all languages, and a row for each context with its log back-off weights. Sorted arrays of
packed sequences are broadcast, within a bound for each language and order. Where the model is larger than that, the
commonest four-character sequences are broadcast, and all others that a text holds are looked up in the tables by joins,
so that the same model scores every text at any size. A text goes to the language with the lowest cross-entropy per
character. All learning rows are in its models. The score is a posterior whose temperature, and the rejection limit whose
level, come from all learning rows as well: they are halved by the hash of their text, and each half is scored by the models
of the other one.

A text that is null or has no letter is `und` with score 0. Marks count as characters but not as letters. Letters beyond
16 bits share 6,400 codes, so that some of them are taken for each other. Equal cross-entropies go to the language that
sorts first. Repeated rows stay separate rows; an empty learning set makes every text `und`. Columns other than doc_id,
text and lang are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators import scans
from .common import slices, split_of, written

#: Sequences of one order that may be broadcast for each language: eight bytes each, and four for each language.
MAX_SEQUENCES = 250_000
#: Share of own-language texts to be rejected, the rows that a language needs for a limit, and the temperatures that are tried.
REJECT, LEAST_ROWS = 0.005, 20
TEMPERATURES = [2.0**i for i in range(-4, 6)]
ORDER = 4
#: The name of both halves together, and the most characters of a language's name.
BOTH, MOST_NAME = "2", 1 << 30
UNSEEN = -16 * np.log(2)
MASKS = [0, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF]
#: Letters beyond 16 bits share the codes of the private use area, which holds no letters.
PRIVATE, PRIVATE_SIZE = 0xE000, 0x1900

_CODES = np.zeros(0, dtype=np.uint16)
_LETTER = np.zeros(0, dtype=bool)


def codes_of(c: np.ndarray) -> tuple[np.ndarray, bool]:
    """The 16-bit code of each code point (0 for all but letters and marks), and whether there is a letter."""
    global _CODES, _LETTER
    if not len(_CODES):
        kind = np.array([unicodedata.category(chr(x))[0] for x in range(0x110000)])
        every = np.arange(0x110000)
        _CODES = np.where(np.isin(kind, ("L", "M")), np.where(every < 0x10000, every, PRIVATE + every % PRIVATE_SIZE), 0).astype(np.uint16)
        _LETTER = kind == "L"
    return _CODES[c], bool(_LETTER[c].any())


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-character sequences of all texts, one for each character after the boundary, and where each text starts.

    Letters are lower-cased; every run of other characters is one boundary (0). A text begins with three boundaries and
    ends with one. A text without a letter has no sequences.
    """
    codes, starts, at = [], [], 0
    for t in texts:
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        c, any_letter = codes_of(c)
        if not any_letter:
            starts.append(at)
            continue
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = c[keep]
        c = c[int(len(c) > 0 and c[0] == 0) :]
        c = c[: len(c) - int(len(c) > 0 and c[-1] == 0)]
        starts.append(at)
        if len(c):
            codes.append(np.concatenate([np.zeros(3, dtype=np.uint64), c.astype(np.uint64), np.zeros(1, dtype=np.uint64)]))
            at += len(c) + 1
    if not codes:
        return np.zeros(0, dtype=np.uint64), np.array(starts)
    keys = [(x[:-3] << np.uint64(48)) | (x[1:-2] << np.uint64(32)) | (x[2:-1] << np.uint64(16)) | x[3:] for x in codes]
    return np.concatenate(keys), np.array(starts)


def counted(rows: DataFrame) -> DataFrame:
    """lang, key, n of every four-character sequence in rows of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                keys = packed([t or "" for l, t in zip(langs, texts) if l == lang])[0]
                if not len(keys):
                    continue
                k, n = np.unique(keys, return_counts=True)
                if lang in totals:
                    k, back = np.unique(np.concatenate([totals[lang][0], k]), return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate([totals[lang][1], n]), minlength=len(k)).astype(np.int64)
                totals[lang] = k, n
            for lang in [x for x, (k, _) in totals.items() if len(k) > 500_000]:  # bounded memory: partial counts leave early
                yield part(lang, *totals.pop(lang))
        for lang, (k, n) in totals.items():
            yield part(lang, k, n)

    def part(lang, k, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    return rows.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def model_rows(counts: DataFrame) -> DataFrame:
    """lang, size, key, n: counts of four characters, continuation counts of fewer."""
    found, level = counts.select("lang", F.lit(ORDER).alias("size"), "key", "n"), counts
    for size in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit(MASKS[size]))
        level = level.groupBy("lang", suffix.alias("key")).agg(F.count("*").alias("n"))
        found = found.unionByName(level.select("lang", F.lit(size).alias("size"), "key", "n"))
    return found


def facts_of(levels: DataFrame, limit: int) -> dict[tuple[str, int], tuple[float, int, int]]:
    """For each language and order the discount, the least bin of counts whose sequences are within the limit, the commonest
    first, and the number of sequences."""
    rows = levels.groupBy("lang", "size", count_bin().alias("bin")).agg(F.count("*").alias("c"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    found: dict[tuple[str, int], tuple[float, int, int]] = {}
    bins: dict[tuple[str, int], list[tuple]] = {}
    for lang, size, *counts in rows.collect():  # twenty bins for each e-fold of a count, for each language and order
        bins.setdefault((lang, size), []).append(tuple(counts))
    for of, counts in bins.items():
        n1, n2 = (sum(c[i] for c in counts) for i in (2, 3))
        least, above = max(c[0] for c in counts) + 1, 0
        for bin_, c, *_ in sorted(counts, reverse=True):
            above += c
            least = bin_ if above <= limit else least
        found[of] = n1 / (n1 + 2.0 * n2) if n1 else 0.5, least, above
    return found


def count_bin() -> Column:
    return F.floor(F.ln("n") * 20).cast("int")


def added(*vectors) -> Column:
    """Sum of arrays, element by element."""
    out, *others = vectors
    for x in others:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def tabled(levels: DataFrame, facts: dict, langs: list[str], leading: str) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order a table (key, logs, common) of the sequences of any language and a table (context, back): arrays of
    log probabilities and of log back-off weights, one element a language. A language that has not seen a sequence of
    another backs off. `common` marks those within the limit of a language whose name begins with `leading`."""
    spark = levels.sparkSession
    discounts = spark.createDataFrame([(lang, size, d, least) for (lang, size), (d, least, _) in facts.items()], "lang string, size int, d double, least int")
    own = Window.partitionBy("lang", "size", "context")  # at most 65,536 rows, as every order's context
    any_ = Window.partitionBy("size", "context")
    each = lambda value: F.array(*[F.max(F.when(F.col("lang") == x, F.col(value))) for x in langs])
    # dealt once, by what all windows and groups share
    full = levels.withColumn("context", F.shiftrightunsigned("key", 16)).repartition("size", "context").join(F.broadcast(discounts), ["lang", "size"])
    full = full.withColumns({"own": (F.col("n") - F.col("d")) / F.sum("n").over(own), "weight": F.col("d") * F.count("*").over(own) / F.sum("n").over(own), "common": (count_bin() >= F.col("least")) & F.col("lang").startswith(leading)})
    full = full.groupBy("size", "context", "key").agg(each("own").alias("own"), each("weight").alias("weight"), F.bool_or("common").alias("common"))
    full = full.withColumn("weight", F.array(*[F.max(F.col("weight")[i]).over(any_) for i in range(len(langs))]))
    full = written(full, "language-weights")
    log = lambda x: F.ln(F.greatest(x, F.lit(1e-12))).cast("float")
    back = F.transform("weight", lambda w: F.when(w.isNull(), F.lit(0).cast("float")).otherwise(log(w)))
    backs = written(full.groupBy("size", "context").agg(F.first("weight").alias("weight")).select("size", "context", back.alias("back")), "language-backs")
    found: dict[int, tuple[DataFrame, DataFrame]] = {}
    for k in range(1, ORDER + 1):
        of = full.where(F.col("size") == k)
        if k == 1:
            of = of.withColumns({"low_p": F.array_repeat(F.lit(1 / 2**16), len(langs)), "low": unseen(langs)})
        else:
            below = found[k - 1][0].select(F.col("key").alias("suffix"), F.col("p").alias("low_p"), F.col("logs").alias("low"))
            of = of.withColumn("suffix", F.col("key").bitwiseAND(F.lit(MASKS[k - 1]))).join(below, "suffix")
        p = added("own", F.zip_with("weight", "low_p", lambda w, low: w * low))
        logs = F.zip_with(F.transform("p", lambda x: F.when(x.isNotNull(), log(x))), added(back, F.col("low")), lambda a, b: F.coalesce(a, b))
        found[k] = written(of.withColumn("p", p).select("key", "p", logs.alias("logs"), "common"), "language-grams"), backs.where(F.col("size") == k)
    return found


def unseen(langs: list[str]) -> Column:
    """Log probabilities of a character that no language has."""
    return F.array_repeat(F.lit(float(UNSEEN)).cast("float"), len(langs))


def looked_up(keys: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]], langs: list[str]) -> DataFrame:
    """key and logs of different four-character sequences, by joins with the tables of all orders."""
    logs, none = unseen(langs), F.array_repeat(F.lit(0).cast("float"), len(langs))
    for k in range(1, ORDER + 1):
        grams, backs = tables[k]
        at = F.col("key").bitwiseAND(F.lit(MASKS[k])) if k < ORDER else F.col("key")
        keys = keys.withColumn("at", at).join(grams.select(F.col("key").alias("at"), F.col("logs").alias(f"logs{k}")), "at", "left")
        keys = keys.withColumn("at", F.shiftrightunsigned("at", 16)).join(backs.select(F.col("context").alias("at"), F.col("back").alias(f"back{k}")), "at", "left").drop("at")
        logs = F.coalesce(F.col(f"logs{k}"), added(F.coalesce(F.col(f"back{k}"), none), logs))
    return keys.select("key", logs.alias("logs"))


class Model:
    """Sorted arrays of sequences with log probabilities, and of contexts with log back-off weights, one column a language.

    A model that is not whole has the commonest sequences of the longest order alone.
    """

    def __init__(self, langs: list[str], tables: dict[int, tuple[DataFrame, DataFrame]], whole: bool):
        self.langs, self.whole = langs, whole
        self.keys, self.logs, self.contexts, self.backs = {}, {}, {}, {}
        for k, (grams, backs) in tables.items():
            if whole:
                self.keys[k], self.logs[k] = self._arrays(grams, "key", "logs")
                self.contexts[k], self.backs[k] = self._arrays(backs, "context", "back")
            elif k == ORDER:
                self.keys[k], self.logs[k] = self._arrays(grams.where("common"), "key", "logs")

    def _arrays(self, rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.select(key, value).toArrow()
        keys = rows.column(key).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        values = np.concatenate([np.zeros(0, dtype=np.float32), *(c.flatten().to_numpy() for c in rows.column(value).chunks)])
        return keys[order], values.reshape(-1, len(self.langs))[order]

    def part(self, start: int, langs: list[str]) -> Model:
        """The same sequences with the columns from `start` on, which get new names."""
        out = object.__new__(Model)
        own = lambda arrays: {k: np.ascontiguousarray(x[:, start : start + len(langs)]) for k, x in arrays.items()}
        out.langs, out.whole, out.keys, out.contexts, out.logs, out.backs = langs, self.whole, self.keys, self.contexts, own(self.logs), own(self.backs)
        return out

    def look(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of the last character given those before it, in every language."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), UNSEEN, dtype=np.float32)
        if not len(self.keys[k]):
            return self.look(k - 1, keys & np.uint64(MASKS[k - 1]))
        at = np.minimum(np.searchsorted(self.keys[k], keys), len(self.keys[k]) - 1)
        out = self.logs[k][at]
        miss = np.flatnonzero(self.keys[k][at] != keys)
        if len(miss):
            rest = keys[miss]
            context = rest >> np.uint64(16)
            c = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            back = np.where((self.contexts[k][c] == context)[:, None], self.backs[k][c], np.float32(0))
            out[miss] = back + self.look(k - 1, rest & np.uint64(MASKS[k - 1]))
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Sum of log probabilities of each text in each language, its number of characters (0: no letter), and the
        sequences, with their numbers, that the sum lacks because the model is not whole."""
        out, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        nothing = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        rest = [nothing] * len(texts)
        group: list[int] = []
        total = 0
        for i, t in enumerate(texts):
            group.append(i)
            total += len(t or "")
            if total > 400_000 or i + 1 == len(texts):
                keys, starts = packed([texts[j] or "" for j in group])
                ends = np.append(starts[1:], len(keys))
                filled = np.flatnonzero(ends > starts)
                sizes[group] = ends - starts
                if len(filled):
                    if self.whole:
                        logs = self.look(ORDER, keys)
                    else:
                        at = np.searchsorted(self.keys[ORDER], keys)
                        known = np.append(self.keys[ORDER], np.uint64(0))[at] == keys
                        known &= at < len(self.keys[ORDER])
                        logs = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
                        logs[known] = self.logs[ORDER][at[known]]
                        for j in filled:
                            rest[group[j]] = np.unique(keys[starts[j] : ends[j]][~known[starts[j] : ends[j]]], return_counts=True)
                    out[np.array(group)[filled]] = np.add.reduceat(logs, starts[filled], axis=0, dtype=np.float64)
                group, total = [], 0
        return out, sizes, rest


def posteriors(entropies: np.ndarray, sizes: np.ndarray, temperature: float) -> np.ndarray:
    z = -(entropies - entropies.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(sizes, 1))[:, None] * temperature
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


class Choice:
    """The language of a text by its cross-entropies, with a calibrated score and limits of rejection."""

    def __init__(self, langs: list[str]):
        self.langs, self.temperature, self.limits = langs, 1.0, {}

    def calibrate(self, judged: DataFrame) -> None:
        """Temperature by likelihood of all judged rows (smoothed); rejection limits by quantile of own-language entropies."""
        losses = judged.agg(*[F.avg(F.col("losses")[i]).alias(f"l{i}") for i in range(len(TEMPERATURES))]).first()
        if losses[0] is None:
            return
        self.temperature = min((loss + 1e-4 * np.log2(t) ** 2, t) for loss, t in zip(losses, TEMPERATURES))[1]
        spread = judged.groupBy("lang").agg(F.count("*").alias("n"), F.stddev_pop("own").alias("sd"))
        high = scans.quantiles(judged, "own", {"high": 1 - REJECT}, ["lang"])
        found = {r["lang"]: r["high"] + r["sd"] for r in spread.where(F.col("n") > LEAST_ROWS).join(high, "lang").collect()}  # a row for each language
        self.limits = {k: found.get(lang, np.inf) for k, lang in enumerate(self.langs)}

    def columns(self, sums: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
        """lang_pred, score, cross_entropy and rejected."""
        n = len(sizes)
        lang, score, entropy, rejected = ["und"] * n, np.zeros(n), [None] * n, [True] * n
        if self.langs and n:
            e = -sums / np.maximum(sizes, 1)[:, None]
            best, p = e.argmin(axis=1), posteriors(e, sizes, self.temperature)
            for i in np.flatnonzero(sizes):
                k = int(best[i])
                lang[i], score[i], entropy[i], rejected[i] = self.langs[k], p[i, k], float(e[i, k]), bool(e[i, k] > self.limits.get(k, np.inf))
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())]


class Scorer:
    """A model as tables, and its broadcast part. `leading` begins the names of the languages whose commonest sequences are broadcast."""

    def __init__(self, counts: DataFrame, limit: int, leading: str = ""):
        levels = written(model_rows(counts), "language-levels")
        facts = facts_of(levels, limit)
        self.langs, self.whole, self.start = sorted({lang for lang, _ in facts}), all(total <= limit for *_, total in facts.values()), 0
        self.tables = tabled(levels, facts, self.langs, leading) if self.langs else {}
        self.every, self.spark = self.langs, counts.sparkSession
        self.model = Model(self.langs, self.tables, self.whole)

    @cached_property
    def sent(self):
        return self.spark.sparkContext.broadcast(self.model)

    def part(self, leading: str) -> Scorer:
        """A scorer of the languages whose names begin with `leading`, named by what follows."""
        own = [x for x in self.langs if x.startswith(leading)]
        out = object.__new__(Scorer)
        out.tables, out.whole, out.every, out.spark = self.tables, self.whole, self.every, self.spark
        out.langs, out.start = [x[len(leading) :] for x in own], self.every.index(own[0]) if own else 0
        out.model = self.model.part(out.start, out.langs)
        return out

    def sums(self, rows: DataFrame) -> DataFrame:
        """Columns of `rows` other than text, with n (characters) and sums (of log probabilities, one a language)."""
        sent = self.sent
        if not self.whole:
            rows = rows.withColumn("row", F.monotonically_increasing_id())
        others = [f for f in rows.schema.fields if f.name != "text"]
        made = [("n", T.LongType()), ("sums", T.ArrayType(T.DoubleType()))]
        if not self.whole:
            made += [("keys", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType()))]
        kind = T.StructType([*others, *(T.StructField(*x) for x in made)])
        n_made = len(made)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1_000):
                sums, n, rest = sent.value.sums(batch.column("text").to_pylist())
                made = [pa.array(n, pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))]
                made += [pa.array([k.view(np.int64) for k, _ in rest], pa.list_(pa.int64())), pa.array([c for _, c in rest], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), *made[:n_made]], kind.names)

        if self.whole:
            return rows.mapInArrow(run, kind)
        known = written(rows.mapInArrow(run, kind), "language-sums")
        asked = known.select("row", F.explode(F.arrays_zip("keys", "times")).alias("a")).select("row", F.col("a.keys").alias("key"), "a.times")
        vectors = written(looked_up(asked.select("key").distinct(), self.tables, self.every), "language-rare")
        more = asked.join(vectors, "key").groupBy("row").agg(F.array(*[F.sum(F.col("times") * F.col("logs")[self.start + i].cast("double")) for i in range(len(self.langs))]).alias("more"))
        return known.join(more, "row", "left").withColumn("sums", F.coalesce(added(F.col("sums"), F.col("more")), "sums")).drop("row", "more", "keys", "times")


def judged(scorer: Scorer, rows: DataFrame) -> DataFrame:
    """lang, own (cross-entropy in the row's language) and losses (one a temperature) of rows of (lang, text) that have
    letters and a language that the scorer knows."""
    langs = scorer.langs
    column = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums = batch.column("n").to_numpy(), np.array(batch.column("sums").to_pylist()).reshape(batch.num_rows, -1)
            lang = batch.column("lang").to_pylist()
            keep = np.flatnonzero([bool(k) and x in column for k, x in zip(n, lang)])
            if not len(keep):
                continue
            truth, n = np.array([column[lang[i]] for i in keep]), n[keep]
            e, at = -sums[keep] / n[:, None], np.arange(len(keep))
            losses = [-np.log(0.99 * posteriors(e, n, t)[at, truth] + 0.01 / len(langs)) for t in TEMPERATURES]
            yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in truth], pa.string()), pa.array(e[at, truth]), pa.array(list(np.column_stack(losses)), pa.list_(pa.float64()))], ["lang", "own", "losses"])

    return scorer.sums(rows).select("lang", "n", "sums").mapInArrow(run, "lang string, own double, losses array<double>")


def learn(docs: DataFrame, learnable, limit: int = MAX_SEQUENCES) -> tuple[Scorer, Choice]:
    """The models of all languages from all learning rows, and how to choose by them, calibrated on all learning rows.

    A language that one half alone holds has no rows that the other half could judge, and gets no limit of rejection.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("string")  # copies of a text share a half
    # each half and both together are languages of one model, named by a digit in front, so that tables are made once for all three
    counts = written(counted(rows.select(F.concat(half, "lang").alias("lang"), "text")), "language-counts")
    both = counts.withColumn("lang", F.concat(F.lit(BOTH), F.substring("lang", 2, MOST_NAME)))
    every = counts.unionByName(both).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    every = Scorer(every, limit, BOTH)
    found = []
    for of, other in ("01", "10"):
        scorer = every.part(other)
        if scorer.langs:
            found.append((scorer, judged(scorer, rows.where(half == of))))
    scorer = every.part(BOTH)
    choice = Choice(scorer.langs)
    if found:
        choice.calibrate(written(reduce(DataFrame.unionByName, [x for _, x in found]), "language-judged"))
        for x, _ in found:
            x.sent.destroy()
    return scorer, choice


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


def identify(docs: DataFrame, limit: int = MAX_SEQUENCES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of every document.

    `limit` bounds what is broadcast; it changes no result but for the order in which sums of logarithms are rounded.
    """
    held = F.coalesce(split_of(folds=4) == 2, F.lit(False))
    scorer, choice = learn(docs, ~held, limit)
    names = [x.split()[0] for x in PREDICTED.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    if scorer.whole:
        sent = scorer.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1_000):
                sums, sizes, _ = sent.value.sums(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *choice.columns(sums, sizes)], names)

        return rows.mapInArrow(run, PREDICTED)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.array(batch.column("sums").to_pylist()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *choice.columns(sums, batch.column("n").to_numpy())], names)

    return scorer.sums(rows).mapInArrow(choose, PREDICTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
