"""Distribution functions as Column expressions: series and continued fractions folded over a fixed number of terms, on the JVM."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that give 1e-12 or better where each form is used.
SERIES, FRACTION, BETA = 60, 70, 200


def _fold(first: Column, terms: Column, step) -> Column:
    return F.aggregate(terms, first, step)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: its series below 2.5, a continued fraction from there on."""
    x = x.cast("double")
    square = x * x
    near = F.least(square, F.lit(6.25))
    # Horner's form of the sum over n of 2^n x^(2n) / (1 * 3 * ... * (2n + 1)).
    series = _fold(F.lit(1.0), F.sequence(F.lit(SERIES), F.lit(1), F.lit(-1)), lambda at, n: 1 + at * 2 * near / (2 * n + 1))
    low = 1 - 2 / sqrt(pi) * x * F.exp(-near) * series
    far = F.greatest(x, F.lit(2.5))
    fraction = _fold(far, F.sequence(F.lit(FRACTION), F.lit(1), F.lit(-1)), lambda at, n: far + (n / F.lit(2.0)) / at)
    return F.when(x < 2.5, low).otherwise(F.exp(-square) / (F.lit(sqrt(pi)) * fraction))


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal Z."""
    return erfc(F.abs(z) / sqrt(2))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0, by Stirling's series from 15 on and the recurrence below."""
    up = F.greatest(F.lit(0), F.ceil(F.lit(15.0) - x)).cast("int")
    lift = F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.lit(0.0), lambda at, k: at + F.when(k < up, F.log(x + k)).otherwise(F.lit(0.0)))
    y = x + up
    tail = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0))) + 1 / (1188 * F.pow(y, F.lit(9.0)))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * 1.8378770664093453) + tail - lift


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last term back."""

    def step(at: Column, n: Column) -> Column:
        m = F.floor(n / F.lit(2)).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(n % 2 == 0, even).otherwise(odd) / at

    return 1 / _fold(F.lit(1.0), F.sequence(F.lit(BETA), F.lit(1), F.lit(-1)), step)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    inside = F.when((x > 0) & (x < 1), x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(inside) + b * F.log(1 - inside))
    small = inside < (a + 1) / (a + b + 2)
    value = F.when(small, front * _beta_fraction(a, b, inside) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - inside) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def t_two_sided_p(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) of Student's T with so many degrees of freedom; null where there are none."""
    freedom = F.when(freedom > 0, freedom.cast("double"))
    return incomplete_beta(freedom / 2, F.lit(0.5), freedom / (freedom + t * t))
