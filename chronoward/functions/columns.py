"""Column expressions: classification, clamping, decoding and shaping of rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F


def replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """`df` with existing columns replaced in place; naming a column that is not there is an error."""
    if missing := set(exprs) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.withColumns(exprs)


def exclude(df: DataFrame, names: Iterable[str]) -> DataFrame:
    names = list(names)
    if missing := set(names) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*names)


def map_columns(df: DataFrame, pattern: str, fn: Callable[[Column], Column]) -> DataFrame:
    """Applies `fn` to every column whose name matches `pattern`."""
    return df.withColumns({c: fn(F.col(c)) for c in df.columns if re.search(pattern, c)})


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """Value of the first rule that holds; a condition that is null does not hold."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def bucket(x: Column, breaks: Sequence[float], labels: Sequence[str], missing: str | None = None) -> Column:
    """Label of the first break above `x` (half-open from below), the last label beyond all of them."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("one more label than breaks")
    rules = [(x.isNull(), missing)] + [(x < b, label) for b, label in zip(breaks, labels)]
    return first_match(rules, labels[-1])


def clamp(df: DataFrame, ceilings: dict[str, float]) -> DataFrame:
    """Caps columns at ceilings; nulls stay null, unlike with a bare least()."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(float(v)))) for c, v in ceilings.items()})


def clip(x: Column, low: float | None, high: float | None) -> Column:
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def cap_day(day: Column, most: int = 7) -> Column:
    """'1'..'7', then '8+'."""
    return F.when(day > most, F.lit(f"{most + 1}+")).otherwise(day.cast("long").cast("string"))


def truthy(df: DataFrame, name: str) -> Column:
    """0/1 of a flag that may be a boolean, a number or text such as '1.0', 'True' or 'Yes'; null counts as 0."""
    if dict(df.dtypes)[name] == "boolean":
        return F.coalesce(F.col(name).cast("int"), F.lit(0))
    text = F.lower(F.trim(F.col(name).cast("string")))
    number = F.expr(f"try_cast(`{name}` AS double)") > 0
    return F.when(F.coalesce(number, F.lit(False)) | F.coalesce(text.isin("true", "yes", "t", "y"), F.lit(False)), 1).otherwise(0)


def yes_no(flag: Column) -> Column:
    return F.when(flag == 1, "Yes").when(flag == 0, "No")


#: Labels of the six groups of day and night differences, in their order.
SIX_GROUPS = (
    "Markedly higher at day", "Slightly higher at day", "Not receiving that day",
    "Receiving and equal", "Slightly higher at night", "Markedly higher at night",
)


def six_groups(day: Column, night: Column, threshold: float) -> Column:
    """Group of night minus day around ±threshold; a missing side counts as 0, both missing as null."""
    d, n = F.coalesce(day, F.lit(0.0)), F.coalesce(night, F.lit(0.0))
    diff = n - d
    return first_match(
        [
            (day.isNull() & night.isNull(), None),
            (diff < -threshold, SIX_GROUPS[0]), (diff > threshold, SIX_GROUPS[5]),
            ((d == 0) & (n == 0), SIX_GROUPS[2]), (diff < 0, SIX_GROUPS[1]), (diff > 0, SIX_GROUPS[4]),
        ],
        SIX_GROUPS[3],
    )


def normalize_categories(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Trims and lower-cases the text columns among `names` that `df` has."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.lower(F.trim(F.col(c))) for c in names if kinds.get(c) == "string"})


def composite_key(parts: Sequence[Column], sep: str = "__") -> Column:
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def split_key(key: Column, position: int, sep: str = "__") -> Column:
    return F.element_at(F.split(key, re.escape(sep)), position)


def by_keyword(text: Column, keywords: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first keyword that the lower-cased text holds."""
    return first_match([(F.lower(text).contains(word), label) for word, label in keywords], default)


def lookup(key: Column, table: dict) -> Column:
    """Value of `key` in a small literal table, null where it is not listed."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def stop_action(has_category: bool) -> Column:
    """Whether a dose record says that nothing runs: by its action category, or else by its action name."""
    if has_category:
        return F.col("mar_action_category").isin("stop", "not_given")
    return F.coalesce(F.col("mar_action_name"), F.lit("")).rlike(r"(?i)stopped|held|paused|not[\s_-]*given")


def given_action(has_category: bool) -> Column:
    if has_category:
        return F.col("mar_action_category") != "not_given"
    return ~F.coalesce(F.col("mar_action_name"), F.lit("")).rlike(r"(?i)not[\s_-]*given")


def drop_missing_times(df: DataFrame, names: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Rows whose listed time columns, other than those in `keep`, are all there."""
    return df.dropna(subset=[c for c in names if c in df.columns and c not in set(keep)])


def matching_columns(df: DataFrame, needles: Iterable[str]) -> list[str]:
    """Columns whose name holds one of the needles, whatever the case, in the order of the table."""
    lowered = [n.lower() for n in needles]
    return [c for c in df.columns if any(n in c.lower() for n in lowered)]


def rescale(df: DataFrame, divisors: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(d)) for c, d in divisors.items() if c in df.columns})


def number_else_text(number: Column, text: str) -> Column:
    """A numeric column, or else the number that the text column `text` holds."""
    return F.coalesce(number, F.expr(f"try_cast(`{text}` AS double)"))


def fixed(name: str, digits: int = 1) -> Column:
    """A number as text with a fixed number of decimals, rounded from its exact binary value, ties to even, as C's printf does.

    format_string rounds Java's shortest decimal text half up instead: 265.15, which lies below the tie, would give 265.2.
    """
    x = F.col(name).cast("double")
    text = F.expr(f"format_number(CAST(`{name}` AS DOUBLE), '0.{'0' * digits}')")
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(text)
