"""Standard normal quantile function as a Spark column expression.

Spark has no built-in inverse normal CDF. This is Wichura's algorithm AS 241
(PPND16, Applied Statistics 37, 1988), accurate to about 1e-16, written as
plain column arithmetic so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published AS 241 coefficients, lowest order first.
# Central region |p - 0.5| <= 0.425, numerator and denominator:
_A = [
    3.387132872796366608, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
    45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727,
]
_B = [
    1.0, 42.313330701600911252, 687.1870074920579083, 5394.1960214247511077,
    21213.794301586595867, 39307.89580009271061, 28729.085735721942674, 5226.495278852545925,
]
# Intermediate tail, r = sqrt(-log(min(p, 1-p))) <= 5, evaluated at r - 1.6:
_C = [
    1.42343711074968357734, 4.6303378461565452959, 5.7694972214606914055, 3.64784832476320460504,
    1.27045825245236838258, 0.24178072517745061177, 0.0227238449892691845833, 7.7454501427834140764e-4,
]
_D = [
    1.0, 2.05319162663775882187, 1.6763848301838038494, 0.68976733498510000455,
    0.14810397642748007459, 0.0151986665636164571966, 5.475938084995344946e-4, 1.05075007164441684324e-9,
]
# Far tail, r > 5, evaluated at r - 5:
_E = [
    6.6579046435011037772, 5.4637849111641143699, 1.7848265399172913358, 0.29656057182850489123,
    0.026532189526576123093, 0.0012426609473880784386, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
_F = [
    1.0, 0.59983220655588793769, 0.13692988092273580531, 0.0148753612908506148525,
    7.868691311456132591e-4, 1.8463183175100546818e-5, 1.4215117583164458887e-7, 2.04426310338993978564e-15,
]


def _poly(coeffs: Sequence[float], x: Column) -> Column:
    """Horner evaluation of sum(coeffs[k] * x**k)."""
    acc = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column | float) -> Column:
    """Φ⁻¹(p) for 0 < p < 1; NULL outside (0, 1)."""
    p = p if isinstance(p, Column) else F.lit(float(p))
    q = p - F.lit(0.5)
    rc = F.lit(0.180625) - q * q
    central = q * _poly(_A, rc) / _poly(_B, rc)
    # bound once: the polynomials read r some thirty times
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near = lambda r: _poly(_C, r - F.lit(1.6)) / _poly(_D, r - F.lit(1.6))
    away = lambda r: _poly(_E, r - F.lit(5.0)) / _poly(_F, r - F.lit(5.0))
    tail = F.transform(F.array(r), lambda r: F.when(r <= F.lit(5.0), near(r)).otherwise(away(r)))[0]
    tail = F.when(q < F.lit(0.0), -tail).otherwise(tail)
    value = F.when(F.abs(q) <= F.lit(0.425), central).otherwise(tail)
    return F.when((p > F.lit(0.0)) & (p < F.lit(1.0)), value)
