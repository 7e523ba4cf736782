"""Statistical formulas as column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winledger.functions.text import let

Z95 = 1.96


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def wilson(succ, n, z: float = Z95) -> Column:
    """Wilson score interval as struct(low, high), NULL when there are no trials."""
    s, m = _col(succ).cast("double"), _col(n).cast("double")
    m = F.nullif(m, F.lit(0.0))
    p = s / m
    shrink = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / shrink
    half = (F.lit(z) / shrink) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.when(
        m.isNotNull(),
        F.struct(
            F.least(p, F.greatest(F.lit(0.0), centre - half)).alias("low"),
            F.greatest(p, F.least(F.lit(1.0), centre + half)).alias("high"),
        ),
    )


def proportion(succ, n) -> Column:
    """A rate with its sample size and interval: struct(value, n, ci_low, ci_high)."""
    ci = wilson(succ, n)
    return F.struct(
        (_col(succ).cast("double") / F.nullif(_col(n).cast("double"), F.lit(0.0))).alias("value"),
        _col(n).cast("long").alias("n"),
        ci["low"].alias("ci_low"),
        ci["high"].alias("ci_high"),
    )


def newcombe(s1, n1, s0, n0, z: float = Z95) -> Column:
    """Interval of p1 - p0 built from the two Wilson intervals; negative means a drop."""
    new, old = wilson(s1, n1, z), wilson(s0, n0, z)
    p1 = _col(s1).cast("double") / F.nullif(_col(n1).cast("double"), F.lit(0.0))
    p0 = _col(s0).cast("double") / F.nullif(_col(n0).cast("double"), F.lit(0.0))
    d = p1 - p0
    low = d - F.sqrt(F.pow(p1 - new["low"], 2.0) + F.pow(old["high"] - p0, 2.0))
    high = d + F.sqrt(F.pow(new["high"] - p1, 2.0) + F.pow(p0 - old["low"], 2.0))
    return F.when(
        d.isNotNull(),
        F.struct(
            F.greatest(F.lit(-1.0), low).alias("low"), F.least(F.lit(1.0), high).alias("high")
        ),
    )


# Hart's rational approximation of the normal tail in double precision, as given
# by G. West, "Better approximations to cumulative normal functions" (2005).
_TAIL_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_TAIL_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)

# Acklam's rational approximation of the inverse normal CDF.
_PPF_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
_PPF_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
_PPF_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
_PPF_D = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
_PPF_TAIL = 0.02425


def _literal(c: float) -> str:
    """A double literal in both SQL dialects."""
    text = repr(float(c))
    return text if "e" in text else text + "e0"


def horner(coefficients, x: str) -> str:
    """A polynomial as SQL text, highest power first."""
    text = _literal(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {_literal(c)})"
    return text


def upper_tail_sql(x: str) -> str:
    """SQL text of P(Z > x) for x >= 0."""
    inner = (
        f"exp(-{x} * {x} / 2.0e0) * {horner(_TAIL_TOP, x)} / {horner(_TAIL_BOTTOM, x)}"
    )
    fraction = f"({x} + 6.5e-1)"
    for k in (4, 3, 2, 1):
        fraction = f"({x} + {k}.0e0 / {fraction})"
    outer = f"exp(-{x} * {x} / 2.0e0) / {fraction} / 2.506628274631e0"
    return (
        f"(case when {x} > 37.0e0 then 0.0e0 when {x} < 7.07106781186547e0 then {inner} "
        f"else {outer} end)"
    )


def ppf_sql(p: str) -> str:
    """SQL text of the inverse normal CDF for 0 < p < 1."""
    def tail(prob: str) -> str:
        q = f"sqrt(-2.0e0 * ln({prob}))"
        return f"({horner(_PPF_C, q)} / {horner(_PPF_D, q)})"

    r = f"(({p} - 5.0e-1) * ({p} - 5.0e-1))"
    middle = f"({horner(_PPF_A, r)} * ({p} - 5.0e-1) / {horner(_PPF_B, r)})"
    return (
        f"(case when {p} < {_literal(_PPF_TAIL)} then {tail(p)} "
        f"when {p} > {_literal(1 - _PPF_TAIL)} then -{tail(f'(1.0e0 - {p})')} else {middle} end)"
    )


def _poly(coefficients, x: Column) -> Column:
    acc = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        acc = acc * x + F.lit(float(c))
    return acc


def upper_tail(x) -> Column:
    """P(Z > x) for any x."""
    def positive(a: Column) -> Column:
        bell = F.exp(-a * a / 2.0)
        near = bell * _poly(_TAIL_TOP, a) / _poly(_TAIL_BOTTOM, a)
        fraction = a + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            fraction = a + F.lit(k) / fraction
        far = bell / fraction / 2.506628274631
        return F.when(a > 37.0, 0.0).when(a < 7.07106781186547, near).otherwise(far)

    value = _col(x).cast("double")
    tail = let(F.abs(value), positive)
    return F.when(value >= 0, tail).when(value < 0, 1.0 - tail)


def normal_cdf(x) -> Column:
    value = _col(x).cast("double")
    return upper_tail(-value)


def normal_ppf(p) -> Column:
    """Inverse normal CDF; NULL outside (0, 1)."""
    def tail(q: Column) -> Column:
        return _poly(_PPF_C, q) / _poly(_PPF_D, q)

    def solve(v: Column) -> Column:
        low = let(F.sqrt(-2.0 * F.log(v)), tail)
        high = -let(F.sqrt(-2.0 * F.log(1.0 - v)), tail)
        c = v - 0.5
        middle = let(c * c, lambda r: _poly(_PPF_A, r) / _poly(_PPF_B, r)) * c
        return F.when(v < _PPF_TAIL, low).when(v > 1 - _PPF_TAIL, high).otherwise(middle)

    value = _col(p).cast("double")
    return F.when((value > 0) & (value < 1), let(value, solve))


def two_proportion_p(sa, na, sb, nb, *, two_sided: bool = True) -> Column:
    """Pooled two-proportion z-test; 1.0 when the pooled spread is zero."""
    xa, ma, xb, mb = (_col(v).cast("double") for v in (sa, na, sb, nb))
    ma, mb = F.nullif(ma, F.lit(0.0)), F.nullif(mb, F.lit(0.0))
    pooled = (xa + xb) / (ma + mb)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / ma + 1 / mb))
    z = (xa / ma - xb / mb) / F.nullif(spread, F.lit(0.0))
    tail = upper_tail(F.abs(z))
    p = F.least(F.lit(1.0), 2 * tail if two_sided else tail)
    return F.when(spread == 0, 1.0).when(spread > 0, p)


def _alpha_quantile(alpha: Column, two_sided: bool) -> Column:
    return normal_ppf(1 - alpha / 2 if two_sided else 1 - alpha)


def sample_size(p, d, alpha=0.05, power=0.8, two_sided: bool = False) -> Column:
    """Trials per arm that detect a drop of ``d`` from rate ``p``; NULL unless 0 < d < p <= 1."""
    p1, delta = _col(p).cast("double"), _col(d).cast("double")
    p2 = p1 - delta
    mid = (p1 + p2) / 2
    za = _alpha_quantile(_col(alpha).cast("double"), two_sided)
    zb = normal_ppf(power)
    top = za * F.sqrt(2 * mid * (1 - mid)) + zb * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    ok = (delta > 0) & (delta < p1) & (p1 <= 1)
    return F.when(ok, F.ceil(top * top / (delta * delta)).cast("long"))


def power(n, p, d, alpha=0.05, two_sided: bool = False) -> Column:
    """Probability of seeing a drop of ``d`` with ``n`` trials per arm."""
    p1, delta, m = _col(p).cast("double"), _col(d).cast("double"), _col(n).cast("double")
    m = F.nullif(m, F.lit(0.0))
    p2 = p1 - delta
    mid = (p1 + p2) / 2
    null_se = F.sqrt(2 * mid * (1 - mid) / m)
    alt_se = F.nullif(F.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / m), F.lit(0.0))
    za = _alpha_quantile(_col(alpha).cast("double"), two_sided)
    return normal_cdf((delta - za * null_se) / alt_se)
