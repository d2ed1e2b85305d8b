"""Problem 7: how characteristic a term is of a record, by a parsimonious language model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeweave.session import broadcast_if_small

#: Share of a record's mass that its own model explains; the background explains the rest.
OWN_SHARE = 0.3
#: Expectation-maximisation ends when a record's own mass changes by less than this part of it, or after so many steps.
TOLERANCE = 1e-9
ITERATIONS = 2_000
#: Terms whose ratios of count to background differ by less than this part share a class in the iterations.
CLASS_WIDTH = 1e-5
#: Largest vocabulary whose background, and number of records whose masses, are broadcast; larger ones are joined by shuffle.
BROADCAST_TERMS = 200_000


def term_counts(df: DataFrame, record: str, term: str, ident: str | None = None) -> DataFrame:
    """Counts (record, term, n) over rows whose record and term are non-null.

    With ``ident``, repeated deliveries of an identifier count once. Counting is
    pre-aggregated, so a record that holds a third of all rows sends one row per term and task.
    """
    rows = df.select(F.col(record).alias("record"), F.col(term).alias("term"), *([F.col(ident).alias("ident")] if ident else [])).filter(F.col("record").isNotNull() & F.col("term").isNotNull())
    if ident:
        rows = rows.distinct()
    return rows.groupBy("record", "term").agg(F.count("*").alias("n"))


def own_mass(n: np.ndarray, background: np.ndarray, own_share: float, tolerance: float = TOLERANCE, iterations: int = ITERATIONS) -> float:
    """Mass of a record (counts ``n``) that its own model explains when expectation-maximisation has converged.

    At the fixed point every term that keeps a weight has weight ``n / mass - rest * background`` with
    ``rest = (1 - own_share) / own_share``, so once the terms that keep one are settled their sums give the limit itself.
    """
    rest = (1 - own_share) / own_share
    weight, mass = n / n.sum(), float(n.sum())
    for _ in range(iterations):
        part = n * weight / (weight + rest * background)
        before, mass = mass, float(part.sum())
        weight = part / mass
        if abs(before - mass) <= tolerance * mass:
            break
    while True:
        kept = n > mass * rest * background
        limit = float(n[kept].sum() / (1 + rest * background[kept].sum()))
        if abs(limit - mass) <= 1e-12 * mass:
            return limit
        mass = limit


def parsimonious_scores(counts: DataFrame, *, own_share: float = OWN_SHARE, tolerance: float = TOLERANCE, class_width: float = CLASS_WIDTH, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(record, term, n, record_n, term_n, total_n, share, background, mass, weight) from counts (record, term, n).

    Expectation-maximisation per record: each term's count is divided between the
    record's own model and the collection's background, and the own model is refitted
    to its part. ``weight`` is the converged probability of the term in the record's own
    model; common terms fall to 0, rare shared terms keep what the background can't
    explain. A term whose share of the record exceeds ``(1 - own_share) / own_share`` times its
    background always keeps a positive weight. ``mass`` is the part of the record's count that its own model explains.

    Terms with the same ratio of count to background move alike in every step, so the iterations run over
    classes of ratios (``class_width`` wide), whose number is bounded whatever a record's vocabulary: counts are summed
    by class before the shuffle, and no task holds the terms of a record. Each term's weight follows from its record's mass.
    Defined cases: an empty table gives no row; a record of one term gives weight 1;
    repeated (record, term) rows must be summed before (``term_counts`` does).
    """
    if not 0 < own_share < 1:
        raise ValueError("own_share must lie between 0 and 1")
    rest = (1 - own_share) / own_share
    kind = dict(counts.dtypes)["record"]
    background = counts.groupBy("term").agg(F.sum("n").alias("term_n"))
    total = background.agg(F.sum("term_n").alias("total_n"))
    x = counts.join(broadcast_if_small(background, broadcast_terms), "term").join(F.broadcast(total))  # one row
    x = x.withColumn("background", F.col("term_n") / F.col("total_n"))
    ratio = F.floor(F.log(F.col("n") / F.col("background")) / class_width).cast("long")
    classes = x.groupBy("record", ratio.alias("ratio")).agg(F.sum("n").cast("double").alias("n"), F.sum("background").alias("background"))

    def solve(rows: pa.Table) -> pa.Table:
        n, b = (rows.column(c).to_numpy() for c in ("n", "background"))
        order = np.argsort(rows.column("ratio").to_numpy())
        return pa.table({"record": rows.column("record").slice(0, 1), "mass": pa.array([own_mass(n[order], b[order], own_share, tolerance)]), "record_n": pa.array([int(n.sum())], pa.int64())})

    masses = classes.groupBy("record").applyInArrow(solve, f"record {kind}, mass double, record_n long")
    y = x.join(broadcast_if_small(masses, broadcast_terms), "record").withColumn("share", F.col("n") / F.col("record_n"))
    y = y.withColumn("weight", F.greatest(F.lit(0.0), F.col("n") / F.col("mass") - F.lit(rest) * F.col("background")))
    return y.select("record", "term", "n", "record_n", "term_n", "total_n", "share", "background", "mass", "weight")
