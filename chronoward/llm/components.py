"""Connected components by alternating large-star and small-star steps, each a join and a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) of every id on an edge of (a, b), the root being the smallest id of its component.

    Every round is written to the shared folder, so a lost executor costs one round. Loops and repeated edges do no harm.
    """
    h = F.xxhash64("hi", "lo")
    # number and order-free hashes of the edges: equal after a round that changed nothing
    marks = {"n": F.count("*"), "s": F.sum(F.shiftright(h, 20)), "x": F.bit_xor(h)}
    pair = lambda df, a, b: df.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = written(pair(edges, "a", "b"), "edges", **marks)
    for _ in range(most_rounds if now.measured["n"] else 0):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pair(both.where("v > u").join(least, "u").select("v", "m"), "v", "m")
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select("lo", "m").union(root.select("hi", "m")).toDF("a", "b")
        after = written(pair(small, "a", "b"), "edges", **marks)
        dropped(now)
        same, now = now.measured == after.measured, after
        if same:
            break
    else:
        if now.measured["n"]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
