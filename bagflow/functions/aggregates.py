"""Composable aggregates. Every one is a set of leaves and an expression over their results.

A leaf says what it folds (an expression of the row), which rows count, and how: as a Catalyst aggregate, as a pair of folds, or
both. Where all leaves have a Catalyst aggregate the group is aggregated by it; one leaf without makes all leaves run as folds in
one pass, for which each built-in has folds too. Mapping, combining and filtering rewrite the expressions in either case."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from bagflow.functions.fold import Fold

Expression = Callable[[Column], Column]


def of(value: Expression | Column | str | None) -> Expression:
    """An expression of the row, which is a struct of its columns: a function of it, a column, or a column's name."""
    if value is None:
        return lambda row: row
    if isinstance(value, str):
        return lambda row: row[value]
    if isinstance(value, Column):
        return lambda row: value
    return value


@dataclass(frozen=True)
class Leaf:
    value: Expression
    where: Expression | None
    native: Callable[[Column, Column | None], Column] | None
    partial: Fold
    final: Fold
    returns: str | None = None
    #: k and whether the greatest are wanted, if the leaf takes the k first of an order; value is then struct(key, row)
    order: tuple[int, bool] | None = None


def _counted(p: Column | None, x: Column) -> Column:
    return x if p is None else F.when(p, x)


@dataclass(frozen=True)
class Aggr:
    """An aggregate of rows. Immutable; the methods give new ones."""

    leaves: tuple[Leaf, ...]
    finish: Callable[[list[Column]], Column] = lambda results: results[0]

    def map(self, f: Expression) -> Aggr:
        """f of the result."""
        return replace(self, finish=lambda results: f(self.finish(results)))

    def lmap(self, g: Expression | Column | str) -> Aggr:
        """Aggregates g of the row in place of the row."""
        g = of(g)
        through = lambda e: None if e is None else lambda row: e(g(row))
        return replace(self, leaves=tuple(replace(leaf, value=through(leaf.value), where=through(leaf.where)) for leaf in self.leaves))

    def dimap(self, g: Expression | Column | str, f: Expression) -> Aggr:
        """g of the row before, f of the result after."""
        return self.lmap(g).map(f)

    def apply(self, other: Aggr, f: Callable[[Column, Column], Column]) -> Aggr:
        """f of both results, from one pass over the rows."""
        n = len(self.leaves)
        return Aggr(self.leaves + other.leaves, lambda results: f(self.finish(results[:n]), other.finish(results[n:])))

    def filtered(self, p: Expression | Column | str) -> Aggr:
        """Only rows with p count (null is false). A group none of whose rows counts stays, with the empty result."""
        p = of(p)
        sure = lambda row: F.coalesce(p(row), F.lit(False))
        both = lambda was: sure if was is None else lambda row: was(row) & sure(row)
        return replace(self, leaves=tuple(replace(leaf, where=both(leaf.where)) for leaf in self.leaves))


def _one(value, native, partial: Fold, final: Fold, **more) -> Aggr:
    return Aggr((Leaf(of(value), None, native, partial, final, **more),))


def _plus(a, b):
    return a if b is None else b if a is None else a + b


def sum_(value=None) -> Aggr:
    """Sum; 0 of nothing. Whole numbers that leave the 64 bits raise an error."""
    zero = Fold(lambda: None, _plus, lambda s: s)
    return _one(value, lambda x, p: F.coalesce(F.sum(_counted(p, x)), F.lit(0)), zero, Fold(lambda: None, _plus, lambda s: 0 if s is None else s))


def integer_sum(value=None) -> Aggr:
    """Sum of whole numbers in 38 digits; beyond them an error, never a wrong number."""
    return sum_(lambda row: of(value)(row).cast("decimal(38,0)"))


def count() -> Aggr:
    """Rows, nulls included."""
    add = Fold(lambda: 0, lambda s, x: s + 1)
    return _one(lambda row: F.lit(1), lambda x, p: F.count(_counted(p, F.lit(1))), add, Fold(lambda: 0, lambda s, x: s + x))


def mean(value=None) -> Aggr:
    """Sum over count; NaN of nothing."""
    first = Fold(lambda: (0.0, 0), lambda s, x: (s[0] + (x or 0.0), s[1] + 1))
    last = Fold(lambda: (0.0, 0), lambda s, x: (s[0] + x[0], s[1] + x[1]), lambda s: s[0] / s[1] if s[1] else float("nan"))

    def native(x: Column, p: Column | None) -> Column:
        n = F.count(_counted(p, F.lit(1)))
        return F.when(n == 0, F.lit(float("nan"))).otherwise(F.coalesce(F.sum(_counted(p, x.cast("double"))), F.lit(0.0)) / n)

    return _one(value, native, first, last)


def _best(better: Callable[[Any, Any], bool]) -> Fold:
    """States are () or (value,), null being the least value."""

    def step(state, x):
        return (x,) if not state or better(x, state[0]) else state

    return Fold(tuple, step)


def _less(a, b) -> bool:
    return b is not None and (a is None or a < b)


def max_(value=None) -> Aggr:
    """The greatest; null is the least value there is, and the result of nothing."""
    each = _best(lambda a, b: _less(b, a))
    return _one(value, lambda x, p: F.max(_counted(p, x)), each, Fold(tuple, lambda s, x: each.step(s, x[0]) if x else s, lambda s: s[0] if s else None))


def min_(value=None) -> Aggr:
    """The least; null where a null is among the rows, and of nothing."""
    each = _best(_less)

    def native(x: Column, p: Column | None) -> Column:
        none = F.count(_counted(p, F.when(x.isNull(), 1)))
        return F.when(none == 0, F.min(_counted(p, x)))

    return _one(value, native, each, Fold(tuple, lambda s, x: each.step(s, x[0]) if x else s, lambda s: s[0] if s else None))


def collect(value=None) -> Aggr:
    """All values, nulls included, in no particular order."""

    def native(x: Column, p: Column | None) -> Column:
        return F.transform(F.collect_list(_counted(p, F.struct(x.alias("x")))), lambda r: r["x"])

    def add(state: list, x) -> list:
        state.append(x)
        return state

    return _one(value, native, Fold(list, add), Fold(list, lambda s, x: s + x))


def distinct_set(value=None) -> Aggr:
    """Different values, null among them, in no particular order."""

    def native(x: Column, p: Column | None) -> Column:
        return F.transform(F.collect_set(_counted(p, F.struct(x.alias("x")))), lambda r: r["x"])

    def step(state, x):
        state.setdefault(repr(x), x)
        return state

    return _one(value, native, Fold(dict, step), Fold(dict, lambda s, x: {**x, **s}, lambda s: list(s.values())))


class _Order:
    """Orders (key, row) pairs by key, null least; reversed if the least are wanted."""

    def __init__(self, pair: dict, greatest: bool):
        self.pair, self.greatest = pair, greatest

    def __lt__(self, other: _Order) -> bool:
        a, b = (_ordered(x.pair["key"]) for x in (self, other))
        return a < b if self.greatest else b < a


def _ordered(x):
    """Nulls before all else, through structs and arrays."""
    if isinstance(x, dict):
        return tuple(_ordered(v) for v in x.values())
    if isinstance(x, list):
        return tuple(_ordered(v) for v in x)
    return (0, 0) if x is None else (1, x)


def _k_first(k: int, key, value, greatest: bool) -> Aggr:
    k = max(k, 0)
    key, value = of(key), of(value)

    def step(state: list, pair) -> list:
        if k:
            item = _Order(pair, greatest)
            if len(state) < k:
                heapq.heappush(state, item)
            elif state[0] < item:
                heapq.heapreplace(state, item)
        return state

    def merge(state: list, more: list) -> list:
        return reduce(lambda s, item: step(s, item.pair), more, state)

    def native(x: Column, p: Column | None) -> Column:
        pairs = F.collect_list(_counted(p, x))
        return F.transform(F.slice(F.sort_array(pairs, not greatest), 1, k), lambda r: r["row"])

    last = Fold(list, merge, lambda s: [item.pair["row"] for item in sorted(s, reverse=True)])
    return _one(lambda row: F.struct(key(row).alias("key"), value(row).alias("row")), native, Fold(list, step), last, order=(k, greatest))


def top_k(k: int, key, value=None) -> Aggr:
    """The k rows (or value of them) with the greatest keys, greatest first; which of equal keys are taken isn't said."""
    return _k_first(k, key, value, True)


def bottom_k(k: int, key, value=None) -> Aggr:
    """The k rows (or value of them) with the least keys, least first."""
    return _k_first(k, key, value, False)


def const(value) -> Aggr:
    """The same value for every group."""
    return _one(lambda row: F.lit(1), lambda x, p: F.lit(value), Fold(lambda: None, lambda s, x: None), Fold(lambda: None, lambda s, x: None, lambda s: value))


def from_fold(partial: Fold, final: Fold, returns: str, value=None) -> Aggr:
    """An aggregate of one's own: partial folds rows where they are, final folds what the partials gave. returns is its type."""
    return _one(value, None, partial, final, returns=returns)


def from_monoid(zero: Callable[[], Any], plus: Callable[[Any, Any], Any], returns: str, value=None) -> Aggr:
    """plus of all values from zero() on."""
    return from_fold(Fold(zero, plus), Fold(zero, plus), returns, value)


def from_reduce(f: Callable[[Any, Any], Any], returns: str, value=None) -> Aggr:
    """f of all values, f being associative; null of nothing."""
    join = lambda s, x: (x,) if not s else (f(s[0], x),)
    return from_fold(Fold(tuple, join), Fold(tuple, lambda s, x: s if not x else join(s, x[0]), lambda s: s[0] if s else None), returns, value)
