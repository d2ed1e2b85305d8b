"""Problem 9: filling containers of fixed capacity with items of varying size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from themeweave.session import cut

#: Items packed together by one task, and shards whose badly filled containers are packed again together.
SHARD_ITEMS = 12_000
SHARDS_TOGETHER = 32
#: Containers filled to less than this share, unless their attention cost is used up, are emptied and packed again.
GOOD_FILL = 0.999
#: Capacities of a container besides its tokens: one item per so many tokens, and the attention cost (sum of squared sizes)
#: as a share of capacity². An item that alone costs more stays alone.
TOKENS_PER_ITEM = 32
ATTENTION_SHARE = 0.85
#: Weights of the residual tokens, items and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 0.25, 0.25)


def best_fit(sizes: np.ndarray, capacity: int, max_items: int, attention: float, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container number of each item by vector best-fit over decreasing sizes.

    Each container has three residual capacities: tokens, items and attention cost. An item
    goes to the container, of those it fits under every constraint, whose weighted norm of
    the residuals left over is least; if none fits a new one is opened. Equal sizes are
    placed in their given order. Items must not exceed the capacity; one that alone exceeds the attention cost gets a
    container to which nothing is added.
    """
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(sizes), np.int64)
    res = np.empty((3, 1024))
    ids = np.empty(1024, np.int64)
    used = made = 0
    scale = (np.sqrt(np.array(weights)) / np.array([capacity, max_items, attention]))[:, None]
    least = np.array([[1.0], [1.0], [1.0]]) * (sizes.min() if len(sizes) else 0)
    least[1], least[2] = 1, least[0] ** 2
    for done, k in enumerate(order):
        s = float(sizes[k])
        need = np.array([[s], [1.0], [s * s]])
        if used and done % 512 == 0:
            # containers that can't take the smallest item are closed
            open_ = (res[:, :used] >= least).all(0)
            n = int(open_.sum())
            res[:, :n], ids[:n] = res[:, :used][:, open_], ids[:used][open_]
            used = n
        best = -1
        if used:
            fits = np.flatnonzero((res[:, :used] >= need).all(0))
            if len(fits):
                left = (res[:, fits] - need) * scale
                best = int(fits[np.argmin((left * left).sum(0))])
        if best < 0:
            if used == len(ids):
                res, ids = np.concatenate([res, np.empty_like(res)], axis=1), np.concatenate([ids, np.empty_like(ids)])
            best, ids[used] = used, made
            res[:, used] = capacity, max_items, attention
            used += 1
            made += 1
        res[:, best] -= need[:, 0]
        place[k] = ids[best]
    return place


def limits(capacity: int, tokens_per_item: float = TOKENS_PER_ITEM, attention_share: float = ATTENTION_SHARE) -> tuple[int, float]:
    """Most items and attention cost of a container."""
    return max(8, int(capacity / tokens_per_item)), attention_share * capacity * capacity


def _pack(tokens_per_item: float, attention_share: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "piece"], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        sizes = pdf["size"].to_numpy(np.int64)
        most, attention = limits(capacity, tokens_per_item, attention_share)
        place = best_fit(sizes, capacity, most, attention)
        fill = np.bincount(place, weights=sizes)
        full = (fill >= capacity * GOOD_FILL) | (np.bincount(place, weights=sizes.astype(float) ** 2) >= attention)
        return pdf.assign(slot=place, fill=fill[place].astype(np.int64), full=full[place])

    return run


def pack_items(items: DataFrame, ident: str, size: str, containers: DataFrame, kind: str, capacity: str, *, shard_items: int = SHARD_ITEMS, tokens_per_item: float = TOKENS_PER_ITEM, attention_share: float = ATTENTION_SHARE, max_kinds: int = 1000) -> DataFrame:
    """(kind, container, ident, piece, size, fill): every item in a container of each kind.

    Items are hashed to shards of about ``shard_items`` that are packed apart by vector
    best-fit; containers that stay badly filled are emptied and their items packed again over
    ``SHARDS_TOGETHER`` shards at once (at most ``SHARDS_TOGETHER * shard_items`` items, whatever the data's
    size), so no task grows with the data. Containers keep to ``limits``. An item larger than
    the capacity is cut into pieces of exactly the capacity and a rest; any other item stays whole.
    Defined cases: items of size 0 or null take no tokens but a place; repeated rows count once
    (of different sizes the larger); kinds with a null or non-positive capacity are left out; an
    empty table gives no row; other columns are ignored.
    """
    kinds = containers.filter(F.col(capacity) > 0).filter(F.col(kind).isNotNull()).select(kind, capacity).distinct().limit(max_kinds + 1).collect()
    if len(kinds) > max_kinds:
        raise ValueError(f"more than {max_kinds} kinds of containers")
    name_kind, item_kind = dict(containers.dtypes)[kind], dict(items.dtypes)[ident]
    pack = _pack(tokens_per_item, attention_share)
    one = cut(items.filter(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("item")).agg(F.max(F.coalesce(F.col(size), F.lit(0)).cast("long")).alias("size")))
    shards = max(1, math.ceil(one.count() / shard_items))
    schema = f"kind {name_kind}, capacity long, item {item_kind}, piece int, size long, shard long, slot long, fill long, full boolean"
    choice = F.array(*[F.struct(F.lit(k).cast(name_kind).alias("kind"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in kinds]) if kinds else None
    if choice is None:
        return one.limit(0).select(F.lit(None).cast(name_kind).alias(kind), F.lit("").alias("container"), F.col("item").alias(ident), F.lit(0).alias("piece"), "size", F.lit(0).cast("long").alias("fill"))
    spread = one.select("item", "size", F.explode(choice).alias("c")).select("c.kind", "c.capacity", "item", "size")
    last = F.greatest(F.ceil(F.col("size") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    pieces = spread.select("kind", "capacity", "item", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda p: F.least(F.col("capacity"), F.col("size") - p * F.col("capacity")))).alias("piece", "size"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    empty = pieces.select("*", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("fill"), F.lit(False).alias("full"))
    first = cut(empty.groupBy("kind", "shard").applyInPandas(pack, schema))
    again = first.filter("NOT full").withColumn("shard", F.floor(F.col("shard") / SHARDS_TOGETHER))
    second = again.groupBy("kind", "shard").applyInPandas(pack, schema)
    name = lambda r: F.concat_ws("-", F.col("kind").cast("string"), F.lit(r), F.col("shard"), F.col("slot"))
    rows = first.filter("full").withColumn("container", name("a")).unionByName(second.withColumn("container", name("b")))
    return rows.select(F.col("kind").alias(kind), "container", F.col("item").alias(ident), "piece", "size", "fill")
