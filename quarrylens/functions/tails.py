"""Tail probabilities of aggregated test results: normal, t, F and chi-square.

Spark has no distribution functions. These work on NumPy arrays of already aggregated
results: a handful of test statistics, or one per group through ``tail_udf``. Continued
fractions run until every element has converged; one that does not is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

TINY = 1e-300
ROUNDS = 200_000
#: Degrees of freedom from which the fraction loses more digits than the limits' corrections.
MANY_T, MANY_F = 1e5, 1e7


def _erfc(x):
    return np.array([math.erfc(v) for v in np.ravel(x)]).reshape(np.shape(x))


def _lgamma(x):
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def _arrays(*values):
    return np.broadcast_arrays(*[np.asarray(v, float) for v in values])


def normal_sf(z):
    return (0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0)))[()]


def log_normal_cdf(z):
    """ln of the normal distribution function, also where it is too small for a double."""
    z = np.asarray(z, float)
    low = np.minimum(z, -30.0)
    far = -low * low / 2 - np.log(-low) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / (low * low) + 3 / low**4)
    near = np.log(0.5 * _erfc(-np.maximum(z, -30.0) / math.sqrt(2.0)))
    return np.where(z < -30.0, far, near)[()]


def _stirling(x):
    """ln Gamma(x) less Stirling's main terms, for x of 10 and more."""
    y = 1.0 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x


def log_beta(a, b):
    """ln B(a, b) without the cancellation of large gammas."""
    a, b = _arrays(a, b)
    p, q = np.minimum(a, b), np.maximum(a, b)
    out = np.empty(p.shape)
    small = q < 10
    out[small] = _lgamma(p[small]) + _lgamma(q[small]) - _lgamma(p[small] + q[small])
    one = ~small & (p < 10)
    s, t = p[one], q[one]
    change = _stirling(t) - _stirling(s + t)
    out[one] = _lgamma(s) + change + s - s * np.log(s + t) + (t - 0.5) * np.log1p(-s / (s + t))
    both = p >= 10
    s, t = p[both], q[both]
    change = _stirling(s) + _stirling(t) - _stirling(s + t)
    out[both] = (
        -0.5 * np.log(t) + 0.5 * math.log(2 * math.pi) + change
        + (s - 0.5) * np.log(s / (s + t)) + t * np.log1p(-s / (s + t))
    )
    return out


def _lentz(term, first, shape):
    """Value of a continued fraction by Lentz's method, element by element."""
    c, d, out = np.ones(shape), np.zeros(shape), np.ones(shape) * first
    live = np.ones(shape, bool)
    for i in range(ROUNDS):
        number, plus = term(i)
        d = plus + number * d
        d = 1.0 / np.where(d == 0, TINY, d)
        c = plus + number / c
        c = np.where(c == 0, TINY, c)
        step = np.where(live, c * d, 1.0)
        out = out * step
        live &= ~(np.abs(step - 1.0) < 1e-15)
        if not live.any():
            return out
    raise ArithmeticError("a tail probability did not converge")


def beta_inc(a, b, x, y=None):
    """Regularised incomplete beta function I_x(a, b). ``y`` is 1 - x where x is too near to 1 to tell."""
    a, b, x = _arrays(a, b, x)
    y = 1.0 - x if y is None else np.broadcast_to(np.asarray(y, float), x.shape)
    out = np.where(x >= 1, 1.0, 0.0) * np.ones(x.shape)
    inside = (x > 0) & (y > 0)
    swap = inside & (x > (a + 1.0) / (a + b + 2.0))
    p, q = np.where(swap, b, a)[inside], np.where(swap, a, b)[inside]
    u, v = np.where(swap, y, x)[inside], np.where(swap, x, y)[inside]
    log_u = np.where(v < 0.5, np.log1p(-np.minimum(v, 0.75)), np.log(u))
    log_v = np.where(u < 0.5, np.log1p(-np.minimum(u, 0.75)), np.log(v))

    def term(i):
        m = i // 2
        if i == 0:
            return np.ones(p.shape), 1.0
        if i % 2 == 0:
            return m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m)), 1.0
        return -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1)), 1.0

    if inside.any():
        fraction = _lentz(term, 1.0, p.shape) - 1.0
        value = np.exp(p * log_u + q * log_v - log_beta(p, q)) / p * fraction
        out[inside] = np.where(swap[inside], 1.0 - value, value)
    return out[()]


def gamma_q(a, x):
    """Regularised upper incomplete gamma function."""
    a, x = _arrays(a, x)
    out = np.ones(x.shape)
    front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - _lgamma(a))
    low = (x > 0) & (x < a + 1.0)
    if low.any():
        s, t = a[low], x[low]
        total = term = 1.0 / s
        for k in range(1, ROUNDS):
            term = term * t / (s + k)
            total = total + term
            if (np.abs(term) <= np.abs(total) * 1e-16).all():
                break
        else:
            raise ArithmeticError("a tail probability did not converge")
        out[low] = 1.0 - front[low] * total
    high = x >= a + 1.0
    if high.any():
        s, t = a[high], x[high]
        c, d = np.full(s.shape, 1.0 / TINY), 1.0 / (t + 1.0 - s)
        result = d.copy()
        for i in range(1, ROUNDS):
            number, plus = -i * (i - s), t + 1.0 - s + 2.0 * i
            d = number * d + plus
            d = 1.0 / np.where(d == 0, TINY, d)
            c = plus + number / c
            c = np.where(c == 0, TINY, c)
            result = result * c * d
            if (np.abs(c * d - 1.0) < 1e-15).all():
                break
        else:
            raise ArithmeticError("a tail probability did not converge")
        out[high] = front[high] * result
    return out[()]


def t_two_sided(t, df):
    """P(|T| > |t|). From MANY_T degrees of freedom: Hill's normal deviate of the same tail."""
    t, df = _arrays(t, df)
    many = df >= MANY_T
    out = np.empty(t.shape)
    u, n = t[~many], df[~many]
    out[~many] = beta_inc(n / 2.0, 0.5, n / (n + u * u), u * u / (n + u * u))
    u, a = t[many], df[many] - 0.5
    b, y = 48 * a * a, a * np.log1p(u * u / df[many])
    curve = ((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1
    out[many] = 2 * normal_sf(curve * np.sqrt(y))
    return out[()]


def f_sf(f, df1, df2):
    """P(F > f). From MANY_F denominator degrees of freedom: the chi-square tail and its first correction."""
    f, df1, df2 = _arrays(f, df1, df2)
    out = np.empty(f.shape)
    square = df1 == 1  # of a t value
    out[square] = t_two_sided(np.sqrt(np.maximum(f[square], 0.0)), df2[square])
    many = ~square & (df2 >= MANY_F)
    few = ~square & ~many
    u, m, n = f[few], df1[few], df2[few]
    out[few] = beta_inc(n / 2.0, m / 2.0, n / (n + m * u), m * u / (n + m * u))
    u, m, n = f[many], df1[many], df2[many]
    x, k = m * u, m / 2.0
    density = np.exp((k - 1) * np.log(np.maximum(x, TINY) / 2) - x / 2 - _lgamma(k)) / 2
    # what the spread of the denominator adds, to the first order in 1 / df2
    out[many] = gamma_q(k, x / 2) + density * x * (x - (m - 2)) / (2 * n)
    return out[()]


def chi2_sf(x, df):
    return gamma_q(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def t_quantile(p, df):
    """Upper quantile (p > 0.5) by bisection on the two-sided tail, to the last bit."""
    p, df = _arrays(p, df)
    target = 2.0 * (1.0 - p)
    low, high = np.zeros(p.shape), np.ones(p.shape)
    while (short := t_two_sided(high, df) > target).any():
        high = np.where(short, 2.0 * high, high)
    while True:
        middle = (low + high) / 2.0
        if ((middle == low) | (middle == high)).all():
            return middle[()]
        above = t_two_sided(middle, df) > target
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def tail_udf(function):
    """Column function over aggregated rows, a batch at a time: NULL in, NULL out."""

    @F.pandas_udf("double")
    def tail(args: pd.DataFrame) -> pd.Series:
        given = args.astype("float64")
        whole = given.notna().all(axis=1).to_numpy()
        out = np.full(len(given), np.nan)
        if whole.any():
            out[whole] = function(*[given[c].to_numpy()[whole] for c in given.columns])
        return pd.Series(out).astype("Float64") if not whole.all() else pd.Series(out)

    return lambda *cols: tail(F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols]))
