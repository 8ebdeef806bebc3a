"""Column expressions over ``array<double>`` vectors. Non-finite elements mark a missing row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
NAN = float("nan")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(v: Column | str) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    v = _col(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalized(v: Column | str) -> Column:
    """L2-normalised; a zero vector stays zero, a NaN vector stays NaN."""

    # Vector and length are bound as variables: a lambda forms what stands in it anew for every element.
    def divided(u: Column) -> Column:
        return F.get(F.transform(F.array(F.greatest(norm(u), F.lit(EPS))), lambda size: F.transform(u, lambda x: x / size)), 0)

    return F.get(F.transform(F.array(_col(v)), divided), 0)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))))


def to_euclidean(v: Column | str, distance: str) -> Column:
    """The vector in whose Euclidean geometry ``distance`` is monotone."""
    if distance == "cosine":
        return normalized(v)
    if distance == "euclidean":
        return _col(v)
    raise ValueError(f"unknown distance: {distance}")


def finite(v: Column | str) -> Column:
    return F.forall(_col(v), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def all_nan(v: Column | str) -> Column:
    return F.forall(_col(v), F.isnan)


def no_nan(x: Column | str, value: float = 0.0) -> Column:
    return F.nanvl(_col(x), F.lit(value))


def null_nan(x: Column | str) -> Column:
    """NULL for NaN, so that aggregates ignore it."""
    x = _col(x)
    return F.when(~F.isnan(x), x)


def clamp(x: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(_col(x), F.lit(lo)), F.lit(hi))


def ceildiv(a: Column | str, b: int) -> Column:
    """The quotient rounded up, in whole numbers throughout."""
    a = _col(a).cast("long")
    return F.call_function("div", a + F.pmod(-a, F.lit(b).cast("long")), F.lit(b).cast("long"))


def argmax(v: Column | str) -> Column:
    """0-based place of the largest element, the first of equal ones."""
    v = _col(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def project(v: Column | str, matrix) -> Column:
    """``matrix @ v`` for a small matrix given as nested lists (rows of literals)."""
    return F.array(*(dot(v, F.array(*(F.lit(float(x)) for x in row))) for row in matrix))


def fourier(v: Column | str, weights) -> Column:
    """Random Fourier features ``[cos(xW), sin(xW)] / sqrt(D)``; ``weights``: D columns of length d."""
    xw = project(v, weights)
    size = float(len(weights)) ** 0.5
    return F.concat(F.transform(xw, lambda x: F.cos(x) / size), F.transform(xw, lambda x: F.sin(x) / size))
