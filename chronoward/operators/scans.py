"""Ordered scans over entities of any size: a hot entity is cut into time slices that are scanned in parallel.

A plain window puts an entity's rows into one task. Here entities with more than one in `most` of all rows (so fewer than `most`) are
cut at quantiles of their times. Every slice is scanned by itself; what it hands on (last value, sum, last state) is one row, these rows
are scanned in turn, and each slice adds what comes in to its own result. What is sent to all tasks is at most `most` entities times
`most` slices of such rows. Cold entities are scanned as before, by the same window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.localtime import micros

MOST = 64
SLICE, HOT = "_slice", "_hot"


def position(df: DataFrame, column: str) -> Column:
    """A time or number as a number that sorts alike."""
    kind = df.schema[column].dataType
    return micros(df, column) if isinstance(kind, T.TimestampType | T.TimestampNTZType) else F.col(column).cast("double")


def sliced(df: DataFrame, by: Sequence[str], time: str, most: int = MOST) -> DataFrame:
    """`df` with a slice number: 0 for cold entities, 0 and more in the order of time for hot ones. Rows of one time share a slice."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = sizes.where(F.col("_n") > max(total / most, 1)).select(*by).collect() if total else []  # fewer than `most` rows
    if not hot:
        return df.withColumns({HOT: F.lit(False), SLICE: F.lit(0)})
    is_hot = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[c])) for c in by]) for row in hot])
    at = position(df, time)
    shares = [i / most for i in range(1, most)]
    cuts = df.where(is_hot).agg(F.percentile_approx(at, shares, 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    number = reduce(lambda a, b: a + b, [F.coalesce((at >= F.lit(c)).cast("int"), F.lit(0)) for c in cuts], F.lit(0))
    return df.withColumn(HOT, is_hot).withColumn(SLICE, F.when(F.col(HOT), number).otherwise(0))


def local(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by, SLICE).orderBy(*order)


def handed_on(rows: DataFrame, by: Sequence[str], hands: dict[str, Column], comes: dict[str, Column]) -> DataFrame:
    """`rows` with what comes into their slice: `hands` sums a slice up, `comes` scans those sums (frame: the slices before)."""
    sums = rows.where(HOT).groupBy(*by, SLICE).agg(*[e.alias(n) for n, e in hands.items()])
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(SLICE).alias("_of"), *[e.over(before).alias(n) for n, e in comes.items()])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]) & (F.col(SLICE) == F.col("_of"))
    return rows.join(F.broadcast(sums), same, "left").drop("_of", *[f"_by{i}" for i in range(len(by))])


def forward_fill(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str], most: int = MOST) -> DataFrame:
    """Last known value of each column up to and with its row; `order` starts with the time."""
    rows = sliced(df, by, order[0], most)
    inside = local(by, order).rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct(*order)
    rows = handed_on(rows, by, {f"_h{i}": F.max_by(c, F.when(F.col(c).isNotNull(), key)) for i, c in enumerate(columns)}, {f"_c{i}": F.last(f"_h{i}", ignorenulls=True) for i in range(len(columns))})
    return rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c{i}")) for i, c in enumerate(columns)}).select(*df.columns)


def running_sum(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], name: str, most: int = MOST) -> DataFrame:
    """Sum of a column up to and with its row."""
    rows = sliced(df, by, order[0], most)
    rows = handed_on(rows, by, {"_h": F.sum(value)}, {"_c": F.sum("_h")})
    inside = local(by, order).rowsBetween(Window.unboundedPreceding, 0)
    here = F.sum(value).over(inside)
    return rows.withColumn(name, F.coalesce(here + F.col("_c"), here, F.col("_c"))).select(*df.columns, name)


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], states: dict[str, Column], most: int = MOST) -> DataFrame:
    """Running numbers of the islands of each state, as `sequence.islands` gives them."""
    rows = sliced(df, by, order[0], most).withColumns({f"_s{i}": F.struct(s.alias("x")) for i, s in enumerate(states.values())})
    key, w = F.struct(*order), local(by, order)
    n = range(len(states))
    rows = handed_on(rows, by, {f"_h{i}": F.max_by(f"_s{i}", key) for i in n}, {f"_c{i}": F.last(f"_h{i}") for i in n})
    before = [F.coalesce(F.lag(f"_s{i}").over(w), F.col(f"_c{i}")) for i in n]
    rows = rows.withColumns({f"_chg{i}": F.when(before[i].isNull() | ~before[i]["x"].eqNullSafe(F.col(f"_s{i}.x")), 1).otherwise(0) for i in n}).drop(*[f"_c{i}" for i in n])
    rows = handed_on(rows, by, {f"_h{i}": F.sum(f"_chg{i}") for i in n}, {f"_c{i}": F.sum(f"_h{i}") for i in n})
    inside = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*df.columns, *[(F.sum(f"_chg{i}").over(inside) + F.coalesce(f"_c{i}", F.lit(0))).alias(name) for i, name in enumerate(states)])


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, take: Sequence[str], tiebreak: Sequence[str] = (), prefix: str = "", most: int = MOST) -> DataFrame:
    """`asof.asof_join` going backward, for keys of any size: the nearest row counts, even where its values are null."""
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    ties = [f"b{i}" for i in range(len(tiebreak))]
    a = right.where(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("t"), F.lit(0).alias("s"), *[F.col(c).alias(b) for c, b in zip(tiebreak, ties)], F.struct(*[F.col(c).alias(f"r_{c}") for c in take]).alias("near"))
    b = left.select(*keys, F.col(left_on).alias("t"), F.lit(1).alias("s"), F.struct(*[F.col(c).alias(f"l_{c}") for c in left.columns]).alias("l"))
    both = forward_fill(a.unionByName(b, allowMissingColumns=True), ["near"], [f"k{i}" for i in range(len(by))], ["t", "s", *ties], most).where("l IS NOT NULL")
    ok = F.col("t").isNotNull()
    return both.select(*[F.col(f"l.l_{c}").alias(c) for c in left.columns], *[F.when(ok, F.col(f"near.r_{c}")).alias(f"{prefix}{c}") for c in take])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """Exact linear quantiles by rank, one column for each name: equal values are counted first, a running count ranks them.

    No group is held in one buffer or task. Nulls and groups of nulls alone give no row.
    """
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    own = keys or ["_all"]
    counts = counts if keys else counts.withColumn("_all", F.lit(0))
    upto = running_sum(counts, "_k", own, ["_v"], "_upto", most)
    totals = counts.groupBy(*own).agg(F.sum("_k").alias("_n")).select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(own)], "_n")
    ranked = upto.join(totals, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(own)]))
    rank = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ends = [F.min(F.when(F.col("_upto") > f(rank(p)), F.col("_v"))).alias(f"_{e}{i}") for i, p in enumerate(shares.values()) for e, f in (("a", F.floor), ("b", F.ceil))]
    found = ranked.groupBy(*own).agg(F.first("_n").alias("_n"), *ends)
    part = lambda p: rank(p) - F.floor(rank(p))
    return found.select(*keys, *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * part(p)).alias(name) for i, (name, p) in enumerate(shares.items())])
