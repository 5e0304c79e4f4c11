"""Vector arithmetic on ``array<double>`` columns, as built-in higher-order expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside lambdas, where nothing is shared otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*(F.lit(float(x)) for x in values))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def l2_norm(v: Column) -> Column:
    """Unit length; an all-zero vector gives nulls (division by zero is undefined)."""
    return let(v, lambda u: let(norm(u), lambda n: F.transform(u, lambda x: F.try_divide(x, n))))


def matvec(rows: Sequence[Sequence[float]], v: Column) -> Column:
    """A literal matrix, given by rows, times a vector."""
    return let(v, lambda u: F.array(*(dot(constant(r), u) for r in rows)))


def logsumexp(v: Column) -> Column:
    return let(v, lambda u: let(F.array_max(u), lambda top: top + F.log(total(F.transform(u, lambda x: F.exp(x - top))))))


def softmax(v: Column) -> Column:
    raised = let(v, lambda u: let(F.array_max(u), lambda top: F.transform(u, lambda x: F.exp(x - top))))
    return let(raised, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax(v: Column) -> Column:
    """Index from 0 of the greatest element, the first of equals."""
    return let(v, lambda u: F.array_position(u, F.array_max(u)) - 1).cast("int")


def nth_best(v: Column, n: int) -> Column:
    """Index from 0 of the ``n``-th greatest element (1: the greatest), the first of equals first."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("neg"), i.alias("i"))))
    return F.get(ranked, F.lit(n - 1))["i"].cast("int")


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))
