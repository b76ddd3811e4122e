"""Integer and integer-pair arithmetic; an operand may be a number or a pair on either side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(i: Column | int, j: Column | int) -> Column:
    """Pair ``(i, j)``."""
    i = i if isinstance(i, Column) else F.lit(i)
    j = j if isinstance(j, Column) else F.lit(j)
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))


def toivec(i: Column) -> Column:
    return vec(i, 0)


def tojvec(j: Column) -> Column:
    return vec(0, j)


def astuple(a: Column, b: Column) -> Column:
    return vec(a, b)


class Vec:
    """A column known to be a pair, so that operators can broadcast a scalar over it."""

    def __init__(self, i: Column, j: Column):
        self.i, self.j = i, j

    @classmethod
    def of(cls, col: Column) -> "Vec":
        return cls(col["i"], col["j"])

    @property
    def col(self) -> Column:
        return vec(self.i, self.j)


Operand = Column | Vec | int


def _lift(function: Callable[..., Column], *operands: Operand):
    if not any(isinstance(x, Vec) for x in operands):
        return function(*[x if isinstance(x, Column) else F.lit(x) for x in operands])

    def side(name: str) -> Column:
        parts = [getattr(x, name) if isinstance(x, Vec) else x for x in operands]
        return function(*[x if isinstance(x, Column) else F.lit(x) for x in parts])

    return Vec(side("i"), side("j"))


def floordiv(a: Column, b: Column) -> Column:
    """Division rounded towards minus infinity."""
    return F.floor(a / b).cast("int")


def add(a: Operand, b: Operand):
    return _lift(lambda x, y: x + y, a, b)


def subtract(a: Operand, b: Operand):
    return _lift(lambda x, y: x - y, a, b)


def multiply(a: Operand, b: Operand):
    return _lift(lambda x, y: x * y, a, b)


def divide(a: Operand, b: Operand):
    return _lift(floordiv, a, b)


def invert(a: Operand):
    return _lift(lambda x: -x, a)


def double(a: Operand):
    return _lift(lambda x: x * 2, a)


def halve(a: Operand):
    return _lift(lambda x: floordiv(x, F.lit(2)), a)


def increment(a: Operand):
    return _lift(lambda x: x + 1, a)


def decrement(a: Operand):
    return _lift(lambda x: x - 1, a)


def sign(a: Operand):
    return _lift(lambda x: F.signum(x).cast("int"), a)


def crement(a: Operand):
    """Away from zero by one; zero stays."""
    return _lift(lambda x: x + F.signum(x).cast("int"), a)


def even(a: Column) -> Column:
    return F.pmod(a, F.lit(2)) == 0


def positive(a: Column) -> Column:
    return a > 0


def greater(a: Column, b: Column) -> Column:
    return a > b


def equality(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def flip(a: Column) -> Column:
    return ~a


def branch(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def identity(a: Column) -> Column:
    return a


def interpolate(low: int, high: int, d: Column) -> Column:
    """Integer bound at difficulty ``d`` between the limits, halves rounded to even."""
    value = F.bround(F.lit(low) + F.lit(high - low) * d, 0).cast("int")
    return F.least(F.greatest(F.lit(low), value), F.lit(high))
