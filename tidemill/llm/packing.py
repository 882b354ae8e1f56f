"""Problem 7: filling containers of fixed capacity with items of varying size.

Best-two-fit. A container is filled greedily with the largest item that fits its gap; while a gap is left, its
smallest item is replaced with the two unpacked items that fit the widened gap most tightly. Items are spread by
hash over buckets of about ``per_bucket`` items, however the sizes or sources are skewed, and each bucket is packed
by itself; every bucket sees the same mixture of sizes, so all that is lost is about one part-filled container each.

Defined results: an item larger than the capacity is cut into pieces of full capacity, each a container of its own,
and one rest; nothing else is cut. Items of size 0 or null (empty and null texts) need no space and
get a container that may hold others. Every piece of every item gives one row. The bucket is told by doc_id, piece and size, so that buckets do not
depend on how the input is split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
PER_BUCKET = 20000
MOST_PARTITIONS = 10000


def pack(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each item; every size must be 0..capacity."""
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, s in enumerate(sizes):
        stock[s].append(i)
    free = 0  # bit s is set where an item of size s is unpacked
    for s in range(1, capacity + 1):
        if stock[s]:
            free |= 1 << s
    out = np.zeros(len(sizes), np.int64)

    def largest(limit: int) -> int:
        return (free & ((2 << limit) - 1)).bit_length() - 1

    def take(s: int) -> int:
        nonlocal free
        i = stock[s].pop()
        if not stock[s]:
            free &= ~(1 << s)
        return i

    number = 0
    while free:
        gap, inside = capacity, []
        while gap and (s := largest(gap)) > 0:
            inside.append((s, take(s)))
            gap -= s
        while gap and free and inside:
            small, item = inside[-1]  # the greedy fill takes ever smaller items; two-for-one keeps the order below
            wide, best = gap + small, (0, 0)
            rest = free & ((2 << wide) - 1)
            x = rest.bit_length() - 1
            while x > 0 and 2 * x > small and sum(best) < wide:
                y = (rest & ((2 << min(x, wide - x)) - 1)).bit_length() - 1 if wide > x else 0
                if y == x and len(stock[x]) < 2:
                    y = (rest & ((1 << x) - 1)).bit_length() - 1
                if y > 0 and x + y > max(small, sum(best)):
                    best = (x, y)
                rest &= (1 << x) - 1
                x = rest.bit_length() - 1
            if not sum(best):
                break
            inside.pop()
            inside.extend((s, take(s)) for s in best)
            inside.sort(reverse=True)
            stock[small].append(item)
            free |= 1 << small
            gap = wide - sum(best)
        for _, i in inside:
            out[i] = number
        number += 1
    return out


def _bucket(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        local = pack(pdf["n_tokens"].tolist(), capacity)
        return pdf.assign(container=pdf["bucket"].astype("int64") * (1 << 32) + local)[["doc_id", "piece_no", "n_tokens", "container"]]

    return run


def fill_containers(items: DataFrame, capacity: int = CAPACITY, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``items``: doc_id, n_tokens. Returns doc_id, piece_no, n_tokens (of the piece), container.

    Containers of buckets have non-negative numbers; full pieces have negative ones, so the two never meet.
    """
    size = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    items = items.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    full = F.floor(F.col("size") / capacity)
    big = items.filter(F.col("size") >= capacity).withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)))
    big = big.select("doc_id", "piece_no", F.lit(capacity).cast("long").alias("n_tokens"), (-F.monotonically_increasing_id() - 1).alias("container"))
    rest = items.select("doc_id", full.alias("piece_no"), (F.col("size") % capacity).alias("n_tokens")).filter("n_tokens > 0 or piece_no = 0")
    n = rest.count()
    buckets = max(1, -(-n // per_bucket))
    salt = F.coalesce("doc_id", F.monotonically_increasing_id())  # rows without an id are spread
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64(salt, "piece_no", "n_tokens"), F.lit(buckets)))
    # what takes no space goes into the first container of its bucket
    empty = rest.filter("n_tokens = 0").select("doc_id", "piece_no", "n_tokens", (F.col("bucket") * (1 << 32)).alias("container"))
    # a given number of partitions: buckets are few bytes and much work, so they must not be merged by size; beyond
    # MOST_PARTITIONS a task packs several buckets
    small = rest.filter("n_tokens > 0").repartition(min(buckets, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInPandas(_bucket(capacity), "doc_id long, piece_no long, n_tokens long, container long")
    return big.unionByName(empty).unionByName(small)
