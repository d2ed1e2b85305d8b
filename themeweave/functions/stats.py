"""Distribution measures as aggregate expressions over counts or shares."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def plogp(share: Column) -> Column:
    """The share's term of the entropy in nats; 0 for a zero share."""
    return F.when(share > 0, -share * F.ln(share)).otherwise(F.lit(0.0))


def entropy(share: Column) -> Column:
    return F.sum(plogp(share))


def support_norm(entropy_raw: Column, nonzero: Column) -> Column:
    """Entropy over the log of the number of non-zero categories; 0 for one or none."""
    return F.when(nonzero > 1, entropy_raw / F.ln(F.when(nonzero > 1, nonzero))).otherwise(F.lit(0.0))


def global_norm(entropy_raw: Column, categories: Column) -> Column:
    """Entropy over the log of the number of categories in the whole corpus."""
    return support_norm(entropy_raw, categories)


def hhi(share: Column) -> Column:
    return F.sum(share * share)


def round6(x: Column) -> Column:
    return F.round(x, 6) + F.lit(0.0)
