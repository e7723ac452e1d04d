"""Quantile functions as column expressions: normal and beta, and draws and schedules built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wichura's rational approximations of the normal quantile (algorithm AS 241, Applied Statistics 37, 1988):
#: numerator and denominator, highest power first, for the centre, the shoulders and the tails.
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
SHOULDER = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _ratio(r, coefficients):
    """A quotient of two polynomials, by Horner's rule; for columns and numbers alike."""
    over, under = coefficients
    n = d = 0.0
    for a, b in zip(over, under):
        n, d = n * r + a, d * r + b
    return n / d


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which a share p lies; infinite at 0 and 1, null outside."""
    q = p - 0.5
    far = F.sqrt(-F.log(F.when(q <= 0, p).otherwise(1 - p)))
    side = F.when(q < 0, -1.0).otherwise(1.0)
    outer = side * F.when(far <= 5, _ratio(far - 1.6, SHOULDER)).otherwise(_ratio(far - 5.0, TAIL))
    inner = q * _ratio(0.180625 - q * q, CENTRE)
    inside = F.when(F.abs(q) <= 0.425, inner).otherwise(outer)
    return F.when(p == 0, float("-inf")).when(p == 1, float("inf")).when((p > 0) & (p < 1), inside)


def _sql_ratio(r: str, coefficients) -> str:
    def horner(c) -> str:
        out = repr(c[0])
        for x in c[1:]:
            out = f"({out} * {r} + {x!r}::DOUBLE)"
        return out

    return f"({horner(coefficients[0])} / {horner(coefficients[1])})"


def normal_quantile_sql(p: str) -> str:
    """DuckDB SQL for the same, of a share between 0 and 1 (exclusive)."""
    far = f"sqrt(-ln(least({p}, 1 - {p})))"
    outer = f"sign({p} - 0.5) * CASE WHEN {far} <= 5 THEN {_sql_ratio(f'({far} - 1.6)', SHOULDER)} ELSE {_sql_ratio(f'({far} - 5.0)', TAIL)} END"
    inner = f"({p} - 0.5) * {_sql_ratio(f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))', CENTRE)}"
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN {inner} ELSE {outer} END)"


#: Halvings of the interval. The continued fraction takes some terms more the larger its parameters are (of 0.05 to 50).
HALVINGS = 42


def _lower_beta(x: Column, a: float, b: float) -> Column:
    """The share of a beta distribution below x <= (a + 1) / (a + b + 2), by its continued fraction, from the last term up."""
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - math.log(a)

    def term(m: Column) -> tuple[Column, Column]:
        odd = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)) * x
        even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) * x
        return odd, even

    def step(acc: Column, m: Column) -> Column:
        odd, even = term(m.cast("double"))
        #: 1 + even / (1 + odd / acc), but for m = 0, which has no even term
        return F.when(m == 0, 1 + odd / acc).otherwise(1 + even / (1 + odd / acc))

    fraction = F.aggregate(F.sequence(F.lit(16 + int(6 * math.sqrt(max(a, b)))), F.lit(0), F.lit(-1)), F.lit(1.0), step)
    return F.when(x <= 0, 0.0).otherwise(F.exp(front + a * F.log(x) + b * F.log(1 - x)) / fraction)


def beta_share(x: Column, a: float, b: float) -> Column:
    """The share of a beta(a, b) distribution below x: the regularised incomplete beta function."""
    turn = (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x <= turn, _lower_beta(x, a, b)).otherwise(1 - _lower_beta(1 - x, b, a))


def beta_quantile(p: Column, a: float, b: float) -> Column:
    """The value below which a share p of a beta(a, b) distribution lies, by halving; null outside 0 to 1."""
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc.low + acc.high) / 2
        return F.get(F.transform(F.array(beta_share(middle, a, b) < p), lambda up: F.struct(F.when(up, middle).otherwise(acc.low).alias("low"), F.when(up, acc.high).otherwise(middle).alias("high"))), 0)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: (acc.low + acc.high) / 2)
    return F.when(p == 0, 0.0).when(p == 1, 1.0).when((p > 0) & (p < 1), found)


#: The normal quantiles between which draws are stretched.
HIGH, LOW = 3.0902, -2.5758


def logit_normal_draw(u: Column, other: Column, which: Column, mu: Column, std: float = 1.0, eps: float = 1e-3, uniform_share: float = 0.1) -> Column:
    """A draw of a shifted logit-normal distribution from a share u: stretched so that its quantiles LOW and HIGH become 0 and 1, reflected
    at eps, cut to 0..1, and replaced by the uniform draw ``other`` where ``which`` is at most ``uniform_share``. For a ``mu`` so large that
    both quantiles lie at one double (from about 39 with std 1) the stretched draw is 1."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    low, high = sigmoid(mu + LOW * std), sigmoid(mu + HIGH * std)
    raw = F.when(high == low, 1.0).otherwise((sigmoid(normal_quantile(u) * std + mu) - low) / (high - low))
    kept = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(raw >= eps, raw).otherwise(2 * eps - raw)))
    return F.when(which > uniform_share, kept).otherwise((1 - eps) * other + eps)


def beta_sigmas(steps: Column, alpha: float = 0.6, beta: float = 0.6, mu: float = 2.37, length: int = 10_000) -> Column:
    """Noise levels of a schedule whose times are beta quantiles of evenly spaced shares, rounded to ``length`` places (halves to even);
    equal places are one step; 0 ends it."""
    shares = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: 1 - i / steps)
    places = F.array_distinct(F.transform(shares, lambda p: F.rint(F.round(beta_quantile(p, alpha, beta), 11) * (length - 1)).cast("long")))
    level = F.transform(places, lambda k: math.exp(mu) / (math.exp(mu) + (length / (k + 1).cast("double") - 1)))
    return F.concat(level, F.array(F.lit(0.0)))
