"""Model formulas as column expressions: `y ~ a + C(b) + cr(x, knots=[1, 2]):d`.

A term is a product (`:`) of numeric columns, treatment-coded columns (`C(b)`, and any text or boolean column) and natural
cubic regression splines (`cr`). What depends on the data (levels, ranges, knots) is found once and pinned, so the same design can
be applied to a table, to another table, or to a single row of values on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Levels that a categorical column may have at most.
MOST_LEVELS = 500
_FACTOR = re.compile(r"(?:(C|cr)\(\s*(\w+)\s*(?:,\s*(knots|df)\s*=\s*(\[[^\]]*\]|\d+)\s*)?\)|(\w+))$")


@dataclass(frozen=True)
class Factor:
    """One factor of a term as it is written: kind is plain, levels or spline."""

    text: str
    kind: str
    column: str
    knots: tuple[float, ...] | None = None
    df: int | None = None


@dataclass(frozen=True)
class Formula:
    outcome: str
    terms: tuple[tuple[Factor, ...], ...]

    def columns(self) -> list[str]:
        """The outcome and every column named, once each."""
        return list(dict.fromkeys([self.outcome, *(f.column for term in self.terms for f in term)]))

    def has_splines(self) -> bool:
        return any(f.kind == "spline" for term in self.terms for f in term)


def cut_outside(text: str, mark: str) -> list[str]:
    """Parts of a text between marks that stand outside brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == mark and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]]]


def parsed(formula: str) -> Formula:
    """A formula's outcome and terms; what it does not know is an error."""
    outcome, _, right = formula.partition("~")
    terms = []
    for text in cut_outside(right, "+"):
        factors = []
        for part in cut_outside(text, ":"):
            if not (m := _FACTOR.match(part)):
                raise ValueError(f"cannot read the term {part!r}")
            call, column, option, value, plain = m.groups()
            if plain:
                factors.append(Factor(part, "plain", plain))
            elif call == "C" and not option:
                factors.append(Factor(part, "levels", column))
            elif call == "cr" and option == "knots":
                factors.append(Factor(part, "spline", column, knots=tuple(float(k) for k in value.strip("[]").split(","))))
            elif call == "cr" and option == "df":
                factors.append(Factor(part, "spline", column, df=int(value)))
            else:
                raise ValueError(f"cannot read the term {part!r}")
        terms.append(tuple(factors))
    return Formula(outcome.strip(), tuple(terms))


def cardinal_spline(knots: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Knots and the cubics of the natural spline basis in which every function is 1 at one knot and 0 at the others.

    Coefficients are [function, piece, power] in powers of the distance from a piece's first knot; the first and last piece are
    straight and lie outside the knots. Second derivatives at inner knots come from the usual tridiagonal system.
    """
    k = np.asarray(knots, dtype=np.float64)
    n, h = len(k), np.diff(k)
    if n < 3 or (h <= 0).any():
        raise ValueError("a spline needs at least three different knots in order")
    system = np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
    jumps = np.zeros((n - 2, n))
    at = np.arange(n - 2)
    jumps[at, at], jumps[at, at + 2] = 1 / h[:-1], 1 / h[1:]
    jumps[at, at + 1] = -jumps[at, at] - jumps[at, at + 2]
    bend = np.zeros((n, n))  # second derivative at each knot of each function
    bend[1:-1] = np.linalg.solve(system, jumps)
    value = np.eye(n)
    coefs = np.zeros((n, n + 1, 4))
    for j in range(n - 1):
        coefs[:, j + 1, 0] = value[j]
        coefs[:, j + 1, 1] = (value[j + 1] - value[j]) / h[j] - h[j] * (2 * bend[j] + bend[j + 1]) / 6
        coefs[:, j + 1, 2] = bend[j] / 2
        coefs[:, j + 1, 3] = (bend[j + 1] - bend[j]) / (6 * h[j])
    coefs[:, 0, 0], coefs[:, 0, 1] = value[0], coefs[:, 1, 1]
    last = coefs[:, n - 1]
    coefs[:, n, 0], coefs[:, n, 1] = value[-1], last[:, 1] + 2 * last[:, 2] * h[-1] + 3 * last[:, 3] * h[-1] ** 2
    return k, coefs


@dataclass(frozen=True)
class Piece:
    """One factor of one design column: a value, an indicator of a level, or a spline function."""

    column: str
    level: str | None = None
    knots: tuple[float, ...] = ()
    function: int = 0

    def expression(self) -> Column:
        x = F.col(f"`{self.column}`")
        if self.level is not None:
            return (x.cast("string") == self.level).cast("double")
        x = x.cast("double")
        if not self.knots:
            return x
        knots, coefs = cardinal_spline(self.knots)
        cubic = lambda j, t: reduce(lambda done, c: done * t + F.lit(float(c)), coefs[self.function, j][2::-1], F.lit(float(coefs[self.function, j][3])))
        line = lambda j, t: F.lit(float(coefs[self.function, j][1])) * t + F.lit(float(coefs[self.function, j][0]))
        out = F.when(x.isNull(), F.lit(None).cast("double")).when(x < float(knots[0]), line(0, x - float(knots[0])))
        for j in range(len(knots) - 1):
            out = out.when(x <= float(knots[j + 1]), cubic(j + 1, x - float(knots[j])))
        return out.otherwise(line(len(knots), x - float(knots[-1])))

    def of(self, values: dict) -> float:
        x = values[self.column]
        if self.level is not None:
            return float(str(x) == self.level)
        if not self.knots:
            return float(x)
        knots, coefs = cardinal_spline(self.knots)
        j = int(np.searchsorted(knots, float(x)))
        return float(np.polyval(coefs[self.function, j][::-1], float(x) - knots[max(j - 1, 0)]))


@dataclass(frozen=True)
class Design:
    """Named design columns, each a product of pieces; the intercept is a product of none."""

    formula: Formula
    columns: tuple[tuple[str, tuple[Piece, ...]], ...]

    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    def expressions(self) -> list[Column]:
        return [expression(pieces) for _, pieces in self.columns]

    def row(self, values: dict) -> np.ndarray:
        """The design's row for one set of values."""
        return np.array([float(np.prod([p.of(values) for p in pieces])) for _, pieces in self.columns])


def expression(pieces: Sequence[Piece]) -> Column:
    return reduce(lambda a, b: a * b, [p.expression() for p in pieces], F.lit(1.0))


def needed_columns(df: DataFrame, formula: str, also: Sequence[str] = (), by_substring: bool = False) -> list[str]:
    """Columns that must have values in the rows of a fit.

    By substring every column counts whose name is part of the formula's text, wherever it stands; this takes in columns that the model
    does not use, and is how published row counts were made.
    """
    names = [c for c in df.columns if c in formula] if by_substring else parsed(formula).columns()
    return list(dict.fromkeys([*names, *also]))


def all_there(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in names], F.lit(True))


def complete_rows(df: DataFrame, formula: str, also: Sequence[str] = (), by_substring: bool = False) -> Column:
    """Whether a row has all values that a formula needs."""
    return all_there(needed_columns(df, formula, also, by_substring))


def text_columns(df: DataFrame) -> set[str]:
    """Columns that are coded by their levels wherever they stand."""
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BooleanType)}


def coded_columns(df: DataFrame, formulas: Sequence[str]) -> list[str]:
    """Columns that the formulas code by their levels."""
    coded = text_columns(df)
    return sorted({f.column for text in formulas for term in parsed(text).terms for f in term if f.kind == "levels" or f.kind == "plain" and f.column in coded})


def level_counts(names: Sequence[str]) -> list[Column]:
    """About how many levels each column has, as aggregates."""
    return [F.approx_count_distinct(f"`{c}`").alias(f"levels{i}") for i, c in enumerate(names)]


def designs(df: DataFrame, formulas: Sequence[str], complete: Sequence[Column], counts: dict[str, int] | None = None) -> list[Design | str]:
    """The design of every formula over its complete rows, or why it has none. Levels and ranges take two aggregations in all, or one
    where the caller has the `level_counts` of the coded columns."""
    read = [parsed(f) for f in formulas]
    coded = text_columns(df)
    is_levels = lambda f: f.kind == "levels" or f.kind == "plain" and f.column in coded
    wanted = [(i, f) for i, formula in enumerate(read) for f in dict.fromkeys(f for term in formula.terms for f in term) if f.kind == "spline" or is_levels(f)]
    # formulas over the same rows share what is found for a factor
    which = [str(c._jc) for c in complete]
    first = {}
    for i, f in wanted:
        first.setdefault((which[i], f), (i, f))
    every, wanted = wanted, list(first.values())
    if wanted:
        value = lambda i, f: F.when(complete[i], F.col(f"`{f.column}`"))
        several = coded_columns(df, formulas)
        if several and counts is None:
            counts = dict(zip(several, df.agg(*level_counts(several)).first()))
        if many := [c for c in several if counts[c] > 1.2 * MOST_LEVELS]:
            raise ValueError(f"columns with too many levels: {many}")
        aggs = [F.sort_array(F.collect_set(value(i, f).cast("string"))) if is_levels(f) else F.array(F.min(value(i, f).cast("double")), F.max(value(i, f).cast("double"))) for i, f in wanted]
        once = dict(zip(wanted, df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()))
        found = {(i, f): once[first[which[i], f]] for i, f in every}
    out: list[Design | str] = []
    for i, formula in enumerate(read):
        try:
            columns: list[tuple[str, tuple[Piece, ...]]] = [("Intercept", ())]
            for term in formula.terms:
                made: list[tuple[str, tuple[Piece, ...]]] = [("", ())]
                for f in term:
                    if is_levels(f):
                        own = [(f"{f.text}[T.{v}]", Piece(f.column, level=v)) for v in found[i, f][1:]]
                    elif f.kind == "spline":
                        knots = all_knots(df.where(complete[i]), f, *found[i, f])
                        own = [(f"{f.text}[{m}]", Piece(f.column, knots=knots, function=m)) for m in range(len(knots))]
                    else:
                        own = [(f.text, Piece(f.column))]
                    made = [(f"{a}:{b}" if a else b, (*p, q)) for a, p in made for b, q in own]
                columns += made
            out.append(Design(formula, tuple(columns)))
        except ValueError as why:
            out.append(str(why))
    return out


def all_knots(rows: DataFrame, f: Factor, low: float | None, high: float | None) -> tuple[float, ...]:
    """Inner knots between the ends of the range of all rows in the fit; `df` puts inner knots at quantiles of the different values."""
    if low is None:
        raise ValueError(f"no rows for {f.text}")
    if f.knots is not None:
        inner = sorted(set(f.knots))
    else:
        shares = [(i + 1) / (f.df - 1) for i in range(f.df - 2)]
        inner = exact_percentiles(rows, f.column, shares)
    if any(k < low or k > high for k in inner):
        raise ValueError(f"knots of {f.text} lie outside its values, {low:g} to {high:g}")
    knots = tuple(sorted({low, high, *inner}))
    if len(knots) < 3:
        raise ValueError(f"too few different knots for {f.text}")
    return knots


def exact_percentiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Linear quantiles of the different values of a column."""
    listed = ", ".join(map(repr, shares))
    once = rows.select(F.col(f"`{column}`").cast("double").alias("x")).where("x IS NOT NULL").distinct()
    return list(once.agg(F.expr(f"percentile(x, array({listed}))")).first()[0])
