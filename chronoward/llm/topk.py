"""Exact top-k search by inner product with a KD-tree per shard.

Components become floor(256 * x) as integers. Space is cut by median splits of a bounded sample; rows go to the shards that the
cuts make, and a shard with too many rows is dealt over several by a hash of the id. Every shard folds equal vectors together
(only their smallest ids can ever be answers), builds a KD-tree by median splits with tight bounding boxes, and answers
blocks of queries: boxes are visited from the highest possible inner product down, until no box can hold a better answer than
the current k-th. The k-th score that a first pass finds on the query's own shard travels with the query: it goes on only to
shards whose box can reach it, and starts from it there.

Vectors that are null or hold a null or non-finite component take no part, neither as query nor as candidate. Vectors of
different lengths are never compared. Equal scores go to the smaller id. A query with fewer than k candidates gets all.
Scores beyond 63 bits count as the largest number of 63 bits, or as its negative, for ranking too.
Repeated rows (same id and vector) count as separate rows, except that a row never answers a query of its own id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import written

#: Rows of a leaf, of a shard, queries of a block, and vectors that the cuts of space are found from.
LEAF, SHARD_ROWS, QUERY_BLOCK, SAMPLE = 64, 4_000, 4_096, 20_000
#: Parts of a cut's number: shard * SALTS + which of its deals.
SALTS = 1 << 20

#: Scores are held inside these bounds.
MOST = 2**63 - 1


def held(score):
    """A score, or an array of them, inside the bounds; floats are exact integers far inside."""
    return np.minimum(np.maximum(score, -MOST), MOST) if getattr(score, "dtype", None) == object else score if isinstance(score, np.ndarray | np.floating) else max(min(score, MOST), -MOST)


class Tree:
    """A KD-tree over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, len(ids)))
        # of equal vectors, the k + 1 smallest ids: one of them may be the query itself
        self.members = [ids[a : a + min(n, k + 1)] for a, n in zip(first, lengths)]
        self.least = ids[first]
        self.vectors = vectors[first]
        self.nodes: list[tuple] = []  # low corner, high corner, (left, right) or the rows of a leaf
        self._build(np.arange(len(first)))

    def _build(self, rows: np.ndarray) -> int:
        points = self.vectors[rows]
        low, high = points.min(axis=0), points.max(axis=0)
        at = len(self.nodes)
        self.nodes.append(None)
        spread = high - low
        axis = int(spread.argmax())
        if len(rows) <= LEAF or spread[axis] == 0:
            self.nodes[at] = low, high, rows
            return at
        cut = np.argpartition(points[:, axis], len(rows) // 2)
        self.nodes[at] = low, high, (self._build(np.sort(rows[cut[: len(rows) // 2]])), self._build(np.sort(rows[cut[len(rows) // 2 :]])))
        return at

    def bound(self, node: int, query: np.ndarray):
        low, high, _ = self.nodes[node]
        return held(np.maximum(query * low, query * high).sum())

    def search(self, own: int, query: np.ndarray, k: int, floor) -> list[tuple[int, int]]:
        """The k best (score, -id), none below `floor`."""
        best: list[tuple[int, int]] = []  # a heap, the worst first
        queue = [(-self.bound(0, query), 0)]
        while queue:
            top, node = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -top < least:
                break
            what = self.nodes[node][2]
            if isinstance(what, tuple):
                for child in what:
                    heapq.heappush(queue, (-self.bound(child, query), child))
                continue
            scores = held(self.vectors[what] @ query)
            for i in np.flatnonzero(scores >= least) if least is not None else range(len(what)):
                score = int(scores[i])
                for vec_id in self.members[what[i]]:
                    if vec_id == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -int(vec_id)))
                    elif (score, -int(vec_id)) > best[0]:
                        heapq.heapreplace(best, (score, -int(vec_id)))
                    else:
                        break
        return best


def as_matrix(column) -> np.ndarray:
    """Rows of numbers as whole ones: floats where every inner product is exact in them, else Python integers."""
    x = np.floor(np.array(list(column), dtype=np.float64))
    if len(x) and np.abs(x).max(initial=0.0) >= (2.0**53 / max(x.shape[1], 1)) ** 0.5:
        return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(len(x), -1)
    return x.reshape(len(x), -1)


def cuts_of(points: np.ndarray, shards: int) -> tuple | int:
    """Median splits of the widest axis, as (axis, cut, up to it, above it), until there are so many parts; a part is its number."""
    made = 0

    def split(rows: np.ndarray, parts: int):
        nonlocal made
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(1)
        axis = int(spread.argmax())
        if parts < 2 or spread[axis] == 0:
            made += 1
            return made - 1
        cut = float(np.median(rows[:, axis]))
        low = rows[:, axis] <= cut
        if low.all():  # more than half lie on the highest value
            low = rows[:, axis] < cut
            cut = float(rows[low, axis].max())
        return axis, cut, split(rows[low], parts // 2), split(rows[~low], parts - parts // 2)

    return split(points, shards)


def part_of(points: np.ndarray, cuts) -> np.ndarray:
    """The part of every point."""
    if not isinstance(cuts, tuple):
        return np.full(len(points), cuts)
    axis, cut, low, high = cuts
    out, below = np.empty(len(points), dtype=np.int64), points[:, axis] <= cut
    out[below], out[~below] = part_of(points[below], low), part_of(points[~below], high)
    return out


def routed(rows: DataFrame, cuts, dims: int) -> DataFrame:
    """`rows` with `space`, the part of their vector; vectors of another length have part -1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            space, usual = np.full(len(frame), -1), (frame["dims"] == dims).to_numpy()
            if usual.any():
                space[usual] = part_of(np.floor(np.array(frame["q"][usual].tolist(), dtype=np.float64)), cuts)
            yield frame.assign(space=space)

    return rows.mapInPandas(run, "vec_id long, q array<double>, dims int, asks boolean, space long")


def boxes_of(data: DataFrame) -> pd.DataFrame:
    """space, dims, low and high corner of every part: a row for each part, first of batches, then of all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield corners(frame.assign(low=frame["q"], high=frame["q"]))

    def corners(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(space, dims, np.floor(np.array(g["low"].tolist(), dtype=np.float64)).min(axis=0), np.floor(np.array(g["high"].tolist(), dtype=np.float64)).max(axis=0)) for (space, dims), g in frame.groupby(["space", "dims"])]
        return pd.DataFrame(out, columns=["space", "dims", "low", "high"])

    kind = "space long, dims int, low array<double>, high array<double>"
    parts = data.select("space", "dims", "q").mapInPandas(run, kind)
    return parts.groupBy("space", "dims").applyInPandas(corners, kind).toPandas()


def search_group(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Answers of one shard (`left`) for the queries that came to it (`right`)."""
    out = []
    for size, rows in left.groupby("dims"):
        queries = right[right["dims"] == size]
        if not len(queries):
            continue
        everything = as_matrix([*rows["q"], *queries["vector"]])
        tree = Tree(rows["vec_id"].to_numpy(), everything[: len(rows)], k)
        for own, vector, floor in zip(queries["query_id"], everything[len(rows) :], queries["floor"]):
            out += [(own, -vec_id, score) for score, vec_id in tree.search(own, vector, k, None if pd.isna(floor) else int(floor))]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row for which `is_query` holds."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * 256.0) < float("inf")))
    rows = (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v * 256.0).alias("q"))
        .withColumn("dims", F.size("q")).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    )
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    dims, total = (sizes["dims"], sizes["n"]) if sizes else (1, 0)
    sample = rows.where(F.col("dims") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").select("q").limit(SAMPLE).toPandas()
    cuts = cuts_of(np.floor(np.array(sample["q"].tolist(), dtype=np.float64)), max(1, -(-total // SHARD_ROWS))) if len(sample) else 0
    data = written(routed(rows, cuts, dims), "topk-rows")
    # a row for each part: how many rows it has, hence over how many shards it is dealt
    deals = {r["space"]: -(-r["n"] // SHARD_ROWS) for r in data.groupBy("space").agg(F.count("*").alias("n")).collect()}
    several = {s: n for s, n in deals.items() if n > 1}
    salt = F.pmod(F.xxhash64("vec_id"), F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for p in several.items() for x in p]), F.col("space").cast("int")), F.lit(1))) if several else F.lit(0)
    data = data.withColumn("shard", F.col("space") * SALTS + salt)
    boxes = boxes_of(data)
    n_asked = data.where("asks").count()
    blocks = max(1, -(-n_asked // QUERY_BLOCK))
    asked = data.where("asks").select(F.col("vec_id").alias("query_id"), F.col("q").alias("vector"), "dims", F.col("shard").alias("at"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("turn")).dropDuplicates(["query_id", "vector"])
    copies = data.select("vec_id", "q", "dims", "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    seats = max(1, min(sum(deals.values()) * blocks, 100_000))
    answer = "query_id long, vec_id long, score long"

    def search(queries: DataFrame) -> DataFrame:
        held_, came = copies.repartition(seats, "shard", "block").groupBy("shard", "block"), queries.repartition(seats, "at", "turn").groupBy("at", "turn")
        return held_.cogroup(came).applyInPandas(lambda a, b: search_group(a, b, k), answer)

    first = written(search(asked.withColumn("floor", F.lit(None).cast("long"))), "topk-own-shard")
    if sum(deals.values()) <= 1:
        found = first
    else:
        # the k-th score on the own shard; a query with fewer answers there starts without a bound
        floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        found = first.unionByName(search(reaching(asked.join(floors, "query_id", "left"), boxes, deals)))
    # each shard sends at most k answers a query, so a query's rows are k times the shards that it reached
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def reaching(asked: DataFrame, boxes: pd.DataFrame, deals: dict[int, int]) -> DataFrame:
    """Every query once for each shard but its own whose box may hold a score of its floor or more.

    Boxes are a row for each part of space, sent to all tasks; bounds get a slack for rounding, so none is missed.
    """
    corners = {d: (g["space"].to_numpy(), np.array(g["low"].tolist()), np.array(g["high"].tolist())) for d, g in boxes.groupby("dims")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, where = [], []
            for i, (vector, dims, floor, own) in enumerate(zip(frame["vector"], frame["dims"], frame["floor"], frame["at"])):
                space, low, high = corners[dims]
                q = np.floor(np.asarray(vector, dtype=np.float64))
                terms = np.maximum(q * low, q * high)
                top = terms.sum(axis=1) + 1e-9 * (1.0 + np.abs(terms).sum(axis=1))
                for s in space if pd.isna(floor) else space[top >= min(float(floor), 2.0**63)]:
                    shards = [int(s) * SALTS + n for n in range(deals[int(s)]) if int(s) * SALTS + n != own]
                    at += [i] * len(shards)
                    where += shards
            yield frame.iloc[at].assign(at=np.array(where, dtype=np.int64))

    return asked.mapInPandas(run, asked.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH base AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(q) AS c, generate_subscripts(q, 1) AS d, len(q) AS n FROM base),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.c * b.c) AS BIGINT) AS score
    FROM parts a JOIN parts b ON a.d = b.d AND a.n = b.n AND a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id, b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
