"""Closed-form statistics as column expressions. Those given as SQL text read the same in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def erfc_sql(x: str, terms: int = 60, depth: int = 40) -> str:
    """erfc(x) for x >= 0 as SQL text, to about 1e-15: a positive series below 2.5, a continued fraction from there."""
    series = "1e0"
    for n in range(terms, 0, -1):
        series = f"(1e0 + 2e0*({x})*({x})/{2 * n + 1}e0*{series})"
    tail = "1e0"
    for n in range(depth, 0, -1):
        tail = f"(1e0 + {n}e0/(2e0*({x})*({x}))/{tail})"
    root = "1.7724538509055160e0"
    # greatest() keeps the branch that is not taken clear of division by zero
    return f"CASE WHEN ({x}) < 2.5e0 THEN 1e0 - 2e0/{root}*exp(-({x})*({x}))*({x})*{series} ELSE exp(-({x})*({x}))/(({x})*{root})/{tail} END"


def two_sided_sql(z: str) -> str:
    """P(|Z| > |z|) of a standard normal; `z` names a column."""
    return erfc_sql(f"abs({z})/sqrt(2e0)")


def chi2_tail_sql(chi2: str) -> str:
    """P(X > chi2) for one degree of freedom."""
    return erfc_sql(f"sqrt({chi2}/2e0)")


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a proportion, clamped to [0, 1]; (0, 0) without trials."""
    nd, zz = F.nullif(n.cast("double"), F.lit(0.0)), F.lit(z * z)
    p = k / nd
    centre = (p + zz / (2 * nd)) / (1 + zz / nd)
    half = z * F.sqrt(p * (1 - p) / nd + zz / (4 * nd * nd)) / (1 + zz / nd)
    tried = F.coalesce(n > 0, F.lit(False))
    return F.when(tried, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(tried, F.least(F.lit(1.0), centre + half)).otherwise(0.0)


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, zz = f"({k}/nullif({n},0e0))", f"{Z95 * Z95!r}e0"
    centre, half = f"({p}+{zz}/(2e0*{n}))/(1e0+{zz}/{n})", f"1.96e0*sqrt({p}*(1e0-{p})/{n}+{zz}/(4e0*{n}*{n}))/(1e0+{zz}/{n})"
    return f"CASE WHEN {n} > 0 THEN greatest(0e0,{centre}-{half}) ELSE 0e0 END", f"CASE WHEN {n} > 0 THEN least(1e0,{centre}+{half}) ELSE 0e0 END"


def false_delisting(p: Column, grace: Column) -> Column:
    """Chance that a live entity is missed `grace` runs in a row."""
    return F.pow(1 - p, grace)


def odds_ratio(stay: Column, become: Column) -> Column:
    """Null where a boundary probability makes it infinite."""
    return F.try_divide(stay * (1 - become), (1 - stay) * become)


def stationary(stay: Column, become: Column) -> Column:
    return F.coalesce(F.try_divide(become, 1 - stay + become), F.lit(0.0))
