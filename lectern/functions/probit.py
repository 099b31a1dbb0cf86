"""The inverse of the standard normal distribution as a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of P. J. Acklam's rational approximation (relative error below 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_TAIL = 0.02425


def _horner(x, coefficients):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def probit(p: Column) -> Column:
    """z with P(Z <= z) = p for 0 < p < 1; null outside and for null."""
    lit = F.lit
    q = F.sqrt(lit(-2.0) * F.log(F.when(p < 0.5, p).otherwise(lit(1.0) - p)))
    tail = _horner(q, tuple(map(lit, _C))) / (_horner(q, tuple(map(lit, _D))) * q + 1.0)
    r = p - 0.5
    centre = _horner(r * r, tuple(map(lit, _A))) * r / (_horner(r * r, tuple(map(lit, _B))) * (r * r) + 1.0)
    return (
        F.when((p <= 0) | (p >= 1), lit(None).cast("double"))
        .when(p < _TAIL, tail)
        .when(p > 1 - _TAIL, -tail)
        .otherwise(centre)
    )


def probit_sql(p: str) -> str:
    """The same in SQL text, for the oracle."""

    def horner(x: str, cs: tuple[float, ...]) -> str:
        text = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:]:
            text = f"({text} * {x} + ({c!r}::DOUBLE))"
        return text

    q = f"sqrt(-2 * ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    r = f"({p} - 0.5)"
    tail = f"({horner(q, _C)} / ({horner(q, _D)} * {q} + 1))"
    centre = f"({horner(f'({r} * {r})', _A)} * {r} / ({horner(f'({r} * {r})', _B)} * ({r} * {r}) + 1))"
    return f"CASE WHEN {p} < {_TAIL} THEN {tail} WHEN {p} > {1 - _TAIL} THEN -{tail} ELSE {centre} END"
