"""Problem 1: the N best rows of every group by two-stage salted ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

#: Subgroups a group is hashed into before the first ranking.
SUBGROUPS = 32


def top_n_per_group(df: DataFrame, group: str, score: str, ident: str, n: int, *, subgroups: int = SUBGROUPS, keep: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows of highest ``score`` of every ``group``, as (group, place, ident, score, *keep).

    Each group is hashed by ``ident`` into ``subgroups`` parts that are ranked apart,
    and only their first ``n`` are ranked again, so no task ever holds a whole group;
    Spark also limits each part before its shuffle. Equal scores go by smaller ``ident``.

    Defined cases: rows with a null group, a null identifier, or a null or NaN score don't
    compete; repeated rows (same group, identifier and score) count once and take one
    place; a group with fewer than ``n`` rows gives all of them; an empty table gives no
    row; other columns are ignored unless named in ``keep`` (the first of repeated rows wins).
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(score)
    usable = df.select(F.col(group).alias("_g"), F.col(ident).alias("_i"), s.alias("_s"), *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keep)]).filter(F.col("_g").isNotNull() & F.col("_i").isNotNull() & F.col("_s").isNotNull())
    if dict(usable.dtypes)["_s"] in ("double", "float"):
        usable = usable.filter(~F.isnan("_s"))
    order = (F.col("_s").desc(), F.col("_i").asc())
    part = usable.withColumn("_p", F.pmod(F.xxhash64("_i"), F.lit(subgroups)))
    first = part.withColumn("_r", F.dense_rank().over(Window.partitionBy("_g", "_p").orderBy(*order))).filter(F.col("_r") <= n)
    # repeated rows lie in the same subgroup with the same rank: one of each goes on
    kept = [f"_k{j}" for j in range(len(keep))]
    one = first.groupBy("_g", "_i", "_s").agg(*[F.first(k).alias(k) for k in kept]) if kept else first.select("_g", "_i", "_s").distinct()
    ranked = one.withColumn("place", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).filter(F.col("place") <= n)
    return ranked.select(F.col("_g").alias(group), "place", F.col("_i").alias(ident), F.col("_s").alias(score), *[F.col(f"_k{j}").alias(k) for j, k in enumerate(keep)])
