"""NULL boundary, tolerance and vector-norm expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column, functions as F

from geotransfer.schemas import SENTINEL

_LARGEST = sys.float_info.max


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """True for a value that is neither NULL, NaN nor infinite (never NULL itself)."""
    return F.coalesce(_in_range(c), F.lit(False))


def _in_range(c) -> Column:
    """NULL for NULL; False for infinities and for NaN, which Spark sorts above every number."""
    v = _col(c).cast("double")
    return (v >= F.lit(-_LARGEST)) & (v <= F.lit(_LARGEST))


def clean(c, sentinel: float = SENTINEL) -> Column:
    """Missing-value boundary: sentinel, NaN and infinities become NULL."""
    v = _col(c).cast("double")
    return F.when(finite(v) & (v != F.lit(sentinel)), v)


def all_finite(columns) -> Column:
    """True when every named column holds a finite value (never NULL itself).

    Written as one SQL text: a hundred columns would cost a thousand driver calls otherwise.
    """
    tests = [f"CAST(`{c}` AS DOUBLE) BETWEEN {-_LARGEST!r}D AND {_LARGEST!r}D" for c in columns]
    return F.expr(f"coalesce({' AND '.join(tests)}, false)")


def to_number(c) -> Column:
    """Numeric parse; text that is not a number becomes NULL."""
    return _col(c).try_cast("double")


def close_to(a, b, tol: float) -> Column:
    return F.abs(_col(a) - _col(b)) <= F.lit(tol)


def between(c, low: float, high: float) -> Column:
    """Range test that is False (not NULL) on missing values and rejects NaN."""
    return F.coalesce(finite(c) & _col(c).between(low, high), F.lit(False))


def squared_norm(vector) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(vector) -> Column:
    return F.sqrt(squared_norm(vector))


def l2_normalise(vector) -> Column:
    v = _col(vector)
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def finite_vector(vector, size: int | None = None) -> Column:
    """All entries finite, at least one non-zero and, when given, the right length."""
    v = _col(vector)
    ok = F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    if size is not None:
        ok = ok & (F.size(v) == size)
    return F.coalesce(ok, F.lit(False))
