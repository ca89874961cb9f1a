"""Product codes of vectors by Lloyd rounds with Elkan's bounds.

Components become floor(256 * x); vectors are cut into equal consecutive parts, each with a codebook of its own. An assignment pass
goes over the table once and leaves, for every vector and part, its entry, an upper bound of the distance to it, and one
lower bound for every entry; these stay in a table in the shared folder. Between passes the driver sees codebooks alone: parts times entries
times part length integers, whatever the size of the table. When entries move, upper bounds grow and lower bounds shrink by the way
moved; then an entry is left out of a comparison only if a bound says that it is strictly farther than the
assigned one: its lower bound, or half its distance from the assigned entry, is above the upper bound. What no bound excludes is
compared by exact integer distances, ties going to the smaller entry, so codes equal those of comparing everything.

Bounds are kept in single precision and always rounded to the safe side.

Defined results. Vectors that are null, empty, or hold null or non-finite components take no part. All vectors must have the length of
that of the smallest id; others take no part either. That length must be a multiple of the number of parts (else a ValueError). Integers
are held within 2**28 in size (components of a million). Fewer vectors than entries make as many entries as there are vectors.
Equal entries are used by their smallest number alone; entries without parts stay as they are. Repeated rows are rows of their own; of
rows that share an id the one with the smaller components comes first. Rows without an id take part but give no first
entries. An empty table gives an empty result. Other columns than `vec_id`, `embedding` and `label` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
HELD = 1 << 28
#: Labels whose errors may be sent to all tasks.
FEW_LABELS, SALTS = 50_000, 16
#: Rows that a task holds as arrays.
ROWS = 512


def whole(docs: DataFrame) -> DataFrame:
    """vec_id, label, q of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = docs.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    held = lambda v: F.floor(F.greatest(F.lit(-float(HELD)), F.least(F.lit(float(HELD)), v * 256.0))).cast("long")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.transform(x, held).alias("q"))


def up(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are not below x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are not above x, and not below 0."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, as integers."""
    d = points - entries
    return (d * d).sum(axis=-1)


def roots(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the square roots of integers, from above and from below."""
    r = np.sqrt(d2.astype(np.float64))
    return up(r * (1 + 1e-12)), down(r * (1 - 1e-12))


def first_pass(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry, squared distance, upper and lower bounds of each point of one part, by all distances."""
    d2 = squares(points[:, None, :], book[None, :, :])
    code = d2.argmin(axis=1)
    own = d2[np.arange(len(points)), code]
    return code, own, roots(own)[0], roots(d2)[1]


def later_pass(points: np.ndarray, book: np.ndarray, apart: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple:
    """The same from shifted bounds. `apart` has half the distances between entries, from below. Also the number of distances computed."""
    n = len(points)
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    own = np.full(n, -1, dtype=np.int64)
    reach = np.where(np.eye(len(book), dtype=bool), np.float32(np.inf), apart).min(axis=1)
    open_ = np.flatnonzero(upper >= reach[code])  # for the others every entry is strictly farther
    own[open_] = squares(points[open_], book[code[open_]])
    upper[open_], lower[open_, code[open_]] = roots(own[open_])
    maybe = (lower[open_] <= upper[open_, None]) & (apart[code[open_]] <= upper[open_, None])
    maybe[np.arange(len(open_)), code[open_]] = False
    row, entry = np.nonzero(maybe)
    d2 = squares(points[open_[row]], book[entry])
    lower[open_[row], entry] = roots(d2)[1]
    # integers decide: the smallest distance, then the smallest entry
    row, entry, d2 = np.append(open_[row], open_), np.append(entry, code[open_]), np.append(d2, own[open_])
    order = np.lexsort((entry, d2, row))
    row, entry, d2 = row[order], entry[order], d2[order]
    best = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=np.int64)
    code[row[best]], own[row[best]] = entry[best], d2[best]
    upper[row[best]] = roots(d2[best])[0]
    return code, own, upper, lower, len(open_) + int(maybe.sum())


def between(books: np.ndarray) -> np.ndarray:
    """Half the distances between the entries of each codebook, from below."""
    return np.stack([roots(squares(b[:, None, :], b[None, :, :]))[1] / np.float32(2) for b in books])


def matrix(column: pa.ListArray, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


STATE = "vec_id long, label {label}, q array<long>, code array<int>, error long, upper array<float>, lower array<float>, computed long"


def lists(x: np.ndarray, kind) -> pa.Array:
    x = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), kind))


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """`rows` with codes, error and bounds; `moved` is how far each entry has gone since their bounds were made, None before there are any."""
    parts, k, width = books.shape
    apart = between(books)
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            n = batch.num_rows
            q = matrix(batch.column("q"), np.int64).reshape(n, parts, width)
            code, error = np.empty((n, parts), dtype=np.int32), np.empty((n, parts), dtype=np.int64)
            upper, lower, computed = np.empty((n, parts), dtype=np.float32), np.empty((n, parts, k), dtype=np.float32), 0
            if moved is not None:
                was, old_upper = matrix(batch.column("code"), np.int64), matrix(batch.column("upper"), np.float32)
                old_lower = matrix(batch.column("lower"), np.float32).reshape(n, parts, k)
            for p in range(parts):
                if moved is None:
                    code[:, p], error[:, p], upper[:, p], lower[:, p] = first_pass(q[:, p], books[p])
                    computed += n * k
                else:
                    high = up(old_upper[:, p].astype(np.float64) + moved[p][was[:, p]])
                    low = down(old_lower[:, p].astype(np.float64) - moved[p][None, :])
                    code[:, p], error[:, p], upper[:, p], lower[:, p], some = later_pass(q[:, p], books[p], apart[p], was[:, p], high, low)
                    computed += some
                    left = np.flatnonzero(error[:, p] < 0)
                    error[left, p] = squares(q[left, p], books[p][code[left, p]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("q"), lists(code, pa.int32()), pa.array(error.sum(axis=1), pa.int64()), lists(upper, pa.float32()), lists(lower, pa.float32()), pa.array([computed] + [0] * (n - 1), pa.int64())],
                names=["vec_id", "label", "q", "code", "error", "upper", "lower", "computed"],
            )

    return rows.mapInArrow(run, STATE.format(label=label))


def moved_books(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New codebooks, and for each entry how far it went, from above. Tasks send a row for each part and entry in use."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * k, dtype=np.int64), np.zeros((parts * k, width), dtype=np.int64)
        for batch in slices(batches, 4096):
            q = matrix(batch.column("q"), np.int64).reshape(-1, width)
            at = (matrix(batch.column("code"), np.int64) + np.arange(parts) * k).reshape(-1)
            n += np.bincount(at, minlength=parts * k)
            np.add.at(total, at, q)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int64()), "n": pa.array(n[used], pa.int64()), "total": lists(total[used], pa.int64()) if len(used) else pa.array([], pa.list_(pa.int64()))})

    sent = state.select("q", "code").mapInArrow(run, "at long, n long, total array<long>")
    sums = sent.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    new = books.reshape(parts * k, width).copy()
    for row in sums.collect():  # parts times entries at most
        new[row["at"]] = [t // row["n"] for t in row["total"]]
    new = new.reshape(books.shape)
    return new, roots(squares(new, books))[0].astype(np.float64)


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """State of every vector after the last assignment (vec_id, label, q, code, error, computed), and the codebooks."""
    rows = whole(vectors)
    start = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "q").select("q").limit(entries).collect()
    if not start:
        return rows.where("false").select("vec_id", "label", "q", F.array(F.lit(0)).alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("computed")), np.zeros((parts, 0, 0), dtype=np.int64)
    dims = len(start[0]["q"])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    if any(len(r["q"]) != dims for r in start):
        start = rows.where((F.size("q") == dims) & F.col("vec_id").isNotNull()).orderBy("vec_id", "q").select("q").limit(entries).collect()
    books = np.array([r["q"] for r in start], dtype=np.int64).reshape(-1, parts, dims // parts).transpose(1, 0, 2)
    state, moved = rows.where(F.size("q") == dims), None
    for turn in range(rounds):
        state = written(assigned(state, books, moved), f"codes-{turn}")
        books, moved = moved_books(state, books)
    return written(assigned(state, books, moved).drop("upper", "lower"), "codes-last"), books


def with_label_errors(state: DataFrame) -> DataFrame:
    """`state` with the error summed over rows of equal label; sums are sent to all tasks if they are few, else dealt out salted."""
    no = F.col("label").isNull()
    totals = state.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("label_"), "label_error")
    totals = written(totals, "codes-labels", n=F.count("*"))
    same = F.col("label").eqNullSafe(F.col("label_"))
    if totals.measured["n"] <= FEW_LABELS:
        return state.join(F.broadcast(totals), same)
    salted = totals.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return state.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", no), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("salt_"))).drop("salt", "salt_")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    state, books = codes(vectors, parts, entries, rounds)
    text = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return with_label_errors(state).select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """Assignment by codebook b{i}, and the next codebook."""
    return f"""
d{i} AS (SELECT p.id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM points p JOIN b{i} b ON b.part = p.part AND b.pos = p.pos GROUP BY ALL),
a{i} AS (SELECT id, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM d{i} GROUP BY ALL),
s{i} AS (SELECT a.part, a.entry, p.pos, sum(p.x) AS s, count(*) AS n FROM a{i} a JOIN points p USING (id, part) GROUP BY ALL),
b{i + 1} AS (SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN b.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM b{i} b LEFT JOIN s{i} USING (part, entry, pos)),"""


ORACLE = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q,
           row_number() OVER (ORDER BY vec_id) AS id
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT id, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS place, len(q) // {PARTS} AS width FROM kept),
points AS (SELECT id, place // width AS part, place % width AS pos, x FROM flat),
b0 AS (SELECT part, id - 1 AS entry, pos, x FROM points WHERE id <= {ENTRIES}),{''.join(_round(i) for i in range(ROUNDS + 1))}
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM b{ROUNDS}),
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (id), books
"""
