"""Numbers: rounding, medians and quantiles in all the variants in use, entropy, log-odds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column, digits: int = 6) -> Column:
    """Half towards plus infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def median_upper(x: str) -> Column:
    """The element at n div 2 of the sorted values."""
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))


def median_mean(x: str) -> Column:
    return F.percentile(x, 0.5)


def quantile_linear(x: str, q: float) -> Column:
    return F.percentile(x, q)


def quantile_floor(x: str, q: float) -> Column:
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor((F.count(x) - 1) * q) + 1).cast("int"))


def quantile_round(x: str, q: float) -> Column:
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor((F.count(x) - 1) * q + 0.5) + 1).cast("int"))


def log_odds_z(y1: Column, y2: Column, n1: Column, n2: Column, prior: float = 100.0) -> Column:
    """Log-odds with an informative Dirichlet prior, as a z-score."""
    a = F.lit(prior) * ((y1 + y2) / (n1 + n2))
    delta = F.log((y1 + a) / (n1 + prior - y1 - a)) - F.log((y2 + a) / (n2 + prior - y2 - a))
    return delta / F.sqrt(1 / (y1 + a) + 1 / (y2 + a))


def flat_log_odds_z(y1: Column, y2: Column, n1: Column, n2: Column, vocabulary: Column, alpha: float = 0.1) -> Column:
    delta = F.log((y1 + alpha) / (n1 - y1 + alpha * vocabulary)) - F.log((y2 + alpha) / (n2 - y2 + alpha * vocabulary))
    return delta / F.sqrt(1 / (y1 + alpha) + 1 / (y2 + alpha))


def entropy_term(p: Column) -> Column:
    """-p log2 p, 0 at 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def log_term(o: Column, e: Column) -> Column:
    """o ln(o / e), 0 where either isn't positive."""
    return F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)
