"""Sample moments with the small-sample corrections used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skewness(x) -> Column:
    """Bias-adjusted skewness; NULL below three values, 0 for a constant column."""
    n = F.count(x)
    factor = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n < 3, None).when(F.min(x) == F.max(x), 0.0).otherwise(F.skewness(x) * factor)


def adjusted_kurtosis(x) -> Column:
    """Bias-adjusted excess kurtosis; NULL below four values, 0 for a constant column."""
    n = F.count(x)
    g2 = F.kurtosis(x)
    spread = F.when(n > 3, (n - 2) * (n - 3))
    return (
        F.when(n < 4, None)
        .when(F.min(x) == F.max(x), 0.0)
        .otherwise(((n + 1) * g2 + 6) * (n - 1) / spread)
    )


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero or NULL."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a.cast("double") / F.when(b != 0, b.cast("double"))
