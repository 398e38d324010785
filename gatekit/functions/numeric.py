"""Small numeric helpers and hash-derived draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(c: Column) -> Column:
    """Clip to [0,1]. Nulls must be filtered first (least/greatest skip them)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body mentions it.

    Column expressions are trees: a sub-expression used five times is five copies. A one-element
    transform binds it to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def r9(c: Column) -> Column:
    """For values built from two-decimal inputs, which can fall exactly between two six-digit numbers."""
    return F.round(c, 9)


def r10(c: Column) -> Column:
    return F.round(c, 10)


def r6_scaled(c: Column) -> Column:
    """Six digits of a value that is not negative, rounded on the scaled double as DuckDB does.

    F.round goes by the decimal digits; shares of whole numbers that fall between two six-digit numbers can differ.
    """
    return let(c * 1e6, lambda x: (F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)) / 1e6)


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(arr: Column) -> Column:
    return array_sum(arr) / F.greatest(F.size(arr), F.lit(1))


def double_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def config_array(rows: list[dict]) -> Column:
    """A literal array of structs: explode it to cross rows with a small config table.

    The number of configs is known when the plan is built, and explode is a
    narrow operator, so no join or shuffle is involved.
    """
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])


def hash_uniform(seed, *keys: Column) -> Column:
    """Uniform draw in [0,1) from 52 bits of md5, the same for the same seed and keys on every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def poisson1_steps(top: int = 18) -> list[float]:
    """Cumulative probabilities of Poisson(1) for 0..top-1; the rest is below the step of a draw."""
    steps, acc = [], 0.0
    for k in range(top):
        acc += math.exp(-1) / math.factorial(k)
        steps.append(acc)
    return steps


def poisson1(u: Column) -> Column:
    """Poisson(1) draw by inverting the distribution at a uniform draw, computed once per row."""
    steps = poisson1_steps()

    def ladder(x: Column) -> Column:
        out = F.lit(len(steps))
        for k in reversed(range(len(steps))):
            out = F.when(x < F.lit(steps[k]), F.lit(k)).otherwise(out)
        return out

    return let(u, ladder)


# Above this mean a Poisson draw is taken from its normal expansion, whose error is then below a hundredth of a step.
POISSON_EXACT = 40.0
# Coefficients of the rational approximation of the normal quantile (relative error 1.2e-9).
QUANTILE_TAIL = 0.02425
QUANTILE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
QUANTILE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
QUANTILE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _horner(coefficients, x):
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_quantile(u: Column) -> Column:
    """The standard normal quantile at u in (0,1)."""

    def tail(q: Column) -> Column:
        return let(F.sqrt(-2.0 * F.log(q)), lambda t: _horner(QUANTILE_C, t) / (_horner(QUANTILE_D, t) * t + 1.0))

    middle = let(u - 0.5, lambda q: let(q * q, lambda r: _horner(QUANTILE_A, r) * q / (_horner(QUANTILE_B, r) * r + 1.0)))
    return F.when(u < QUANTILE_TAIL, tail(u)).when(u > 1 - QUANTILE_TAIL, -tail(1.0 - u)).otherwise(middle)


def poisson_steps(mean: Column) -> Column:
    """Cumulative probabilities of Poisson(mean) as an array, as far as a draw can tell; empty above POISSON_EXACT."""

    def steps(lam: Column) -> Column:
        start = F.struct(F.exp(-lam).alias("p"), F.exp(-lam).alias("below"), F.array(F.exp(-lam)).alias("all"))

        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * lam / k
            return F.struct(p.alias("p"), (acc["below"] + p).alias("below"), F.array_append(acc["all"], acc["below"] + p).alias("all"))

        far = (lam + 12.0 * F.sqrt(lam) + 20.0).cast("int")
        return F.aggregate(F.sequence(F.lit(1), far), start, step)["all"]

    return F.when(mean <= POISSON_EXACT, steps(mean.cast("double"))).otherwise(F.array().cast("array<double>"))


def poisson_total(u: Column, mean: Column, steps: Column) -> Column:
    """A Poisson draw at a uniform draw: the sum of `mean` Poisson(1) draws, taken at once. steps: `poisson_steps(mean)`."""
    wide = let(normal_quantile(F.greatest(u, F.lit(2.0**-53))), lambda z: F.floor(mean + F.sqrt(mean) * z + (z * z - 1.0) / 6.0 + 0.5))
    exact = F.size(F.filter(steps, lambda c: u >= c)).cast("long")
    return F.when(mean <= POISSON_EXACT, exact).otherwise(F.greatest(F.lit(0).cast("long"), wide.cast("long")))
