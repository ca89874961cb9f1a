"""All pairs of different components inside buckets, whatever a bucket's size.

A first round has linked most members of every bucket. What is left are pairs that lie in different components. Small
buckets give them as rows. Large ones are cut into blocks by a hash of the id, those of the component of the smallest id (the
home) apart from the rest, and every two blocks that may hold such a pair meet in one task, which compares all of them
exactly: no pair is left out, no task gets a bucket whole, and the rows dealt out are the members times the blocks that they
have to meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

#: Members of a block, members of the largest bucket whose pairs become rows, columns of a product.
BLOCK, FEW, COLUMNS = 512, 16, 4096


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of sets, sorted and without repeats, with at least that Jaccard similarity."""
    same = left is right
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    values = np.concatenate(left if same else [*left, *right])
    row = np.repeat(np.arange(len(left) if same else len(left) + len(right)), sizes[0] if same else np.concatenate(sizes))
    # elements in order, those that one set alone has left out
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    again = values[1:] == values[:-1]
    several = np.append(again, False) | np.append(False, again) if len(values) else np.zeros(0, dtype=bool)
    values, row = values[several], row[several]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    if len(values):
        at = np.cumsum(np.append(True, values[1:] != values[:-1])) - 1
        entries = [(at, row)] if same else [(at[mine], row[mine] - less) for mine, less in ((row < len(left), 0), (row >= len(left), len(left)))]
        common = int(at[-1]) + 1
        for begin in range(0, common, COLUMNS):
            parts = []
            for (at, row), n in zip(entries, sizes):
                a, b = np.searchsorted(at, [begin, begin + COLUMNS])
                part = np.zeros((len(n), min(COLUMNS, common - begin)), dtype=np.float32)
                part[row[a:b], at[a:b] - begin] = 1
                parts.append(part)
            shared += parts[0] @ parts[-1].T
    shared = shared.astype(np.float64)
    return np.nonzero((shared > 0) & (shared >= (sizes[0][:, None] + sizes[1][None, :] - shared) * similarity))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links (a, b), each as links from its smallest id to all others: no more links than ids."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while (apart := parent[x] != parent[y]).any():
        u, v = parent[x[apart]], parent[y[apart]]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    far = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[parent[far]], ids[far]


def crossing_links(member: DataFrame, roots: DataFrame, content: DataFrame, verified: Callable, sets_of: Callable, similarity: float, spanning: bool = False, narrowed: Callable | None = None) -> DataFrame:
    """Links (a, b) between members of one bucket that lie in different components.

    `member` has bucket and id; `content` has an id and what is compared; `verified` takes pairs and content; `sets_of`
    turns a list of contents into sets. With `spanning`, two blocks of a large bucket give links between the roots of the
    components that they connect, at most one a root, instead of a row for each pair of members: the components are the same.
    `narrowed` may cut content to what the ids of large buckets (a table, at most so many) need, before it is shuffled.
    """
    inside = member.select("bucket", "id").join(roots.toDF("id", "root"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    several = inside.groupBy("bucket").agg(F.min_by("root", "id").alias("home"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_ = written(inside.join(several.select("bucket", "home"), "bucket").select("bucket", "id", "root", (F.col("root") != F.col("home")).alias("apart")), "crossing-members", n=F.count("*"))
    most = open_.measured["n"]
    counts = open_.groupBy("bucket").agg(F.count_if("apart").alias("n_apart"), F.count_if(~F.col("apart")).alias("n_home"))
    open_ = open_.join(counts, "bucket")
    few = open_.where(F.col("n_apart") + F.col("n_home") <= FEW).select("bucket", "id", "root")
    pairs = few.toDF("bucket", "a", "root_a").join(few.toDF("bucket", "b", "root_b"), "bucket").where("a < b AND root_a <> root_b").select("a", "b").distinct()
    links = verified(written(pairs, "crossing-pairs"), content).select("a", "b")

    cut = lambda n: F.ceil(F.col(n) / BLOCK)
    block = F.when(F.col("apart"), F.pmod(F.xxhash64("id"), cut("n_apart"))).otherwise(cut("n_apart") + F.pmod(F.xxhash64("id"), F.greatest(cut("n_home"), F.lit(1))))
    many = open_.where(F.col("n_apart") + F.col("n_home") > FEW).select("bucket", "id", "root", block.alias("block"), cut("n_apart").alias("apart_blocks"), cut("n_home").alias("home_blocks"))
    # a block of the first component meets all others but its own kind
    last = F.when(F.col("block") < F.col("apart_blocks"), F.col("apart_blocks") + F.col("home_blocks")).otherwise(F.col("apart_blocks")) - 1
    dealt = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root")
    id_name, content_name = content.columns
    content = narrowed(content, many.select("id"), most) if narrowed else content
    rows = dealt.join(content.withColumnRenamed(id_name, "id"), "id").withColumnRenamed(content_name, "content")

    def run(table: pa.Table) -> pa.Table:
        ids, root, block, i, j = (table.column(c).to_numpy() for c in ("id", "root", "block", "i", "j"))
        sets = sets_of(table.column("content"))
        first, second = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        if not len(first) or not len(second):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        left = [sets[k] for k in first]
        x, y = near_pairs(left, left if i[0] == j[0] else [sets[k] for k in second], similarity)
        x, y = first[x], second[y]
        keep = root[x] != root[y]
        x, y = stars(root[x[keep]], root[y[keep]]) if spanning else (ids[x[keep]], ids[y[keep]])
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    return links.union(rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")).distinct()
