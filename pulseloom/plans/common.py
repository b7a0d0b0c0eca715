"""What queries and their SQL twins share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Doubles rounded, and without a negative zero, as both engines sum in their own order."""
    chosen = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in chosen})


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"


def normal_tail(z: str) -> str:
    """P(Z > z) of a z of 0 or more, by the series of z ** (2 n + 1) / (1 * 3 * ... * (2 n + 1))."""
    terms = f"list_transform(range(300), lambda n: exp((2 * n + 1) * ln({z}) - (n + 1) * ln(2) - lgamma(n + 1.5) + 0.5 * ln(pi())))"
    return f"CASE WHEN {z} <= 0 THEN 0.5 ELSE greatest(0, 0.5 - exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum({terms})) END"


def chi2_tail(x: str, k: str) -> str:
    """P(X > x) of chi-square with k degrees of freedom, by the series of the lower incomplete gamma function."""
    terms = f"list_transform(range(500), lambda n: exp(({k} / 2.0 + n) * ln({x} / 2) - {x} / 2 - lgamma({k} / 2.0 + n + 1)))"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0, 1 - list_sum({terms})) END"
