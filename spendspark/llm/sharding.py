"""Uniform shuffle into shards of exact sizes, by a drawn communication matrix.

How many rows each input partition sends to each shard is drawn exactly: row by row of the
matrix, from the hypergeometric law that a uniform permutation of all rows would follow. Each
partition permutes its rows and deals them out by these counts, the shards permute what they
get. No row count is left to chance, and no global sort is needed.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendspark.llm.storage import stored

MAX_PARTS = 4096
GROUP_ROWS = 1_000_000


def draw_hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of ``good + bad``: inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    top = math.exp(log_ways(good, mode) + log_ways(bad, draws - mode)
                   - log_ways(good + bad, draws))
    left = rng.random() - top
    up = down = mode
    p_up = p_down = top
    while left > 0:
        if up >= high and down <= low:  # what rounding has left
            return mode
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up == 0 and p_down == 0:
            return mode
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts from each part to each shard; rows sum to ``parts``, columns to ``shards``."""
    rng, room, matrix = random.Random(seed), list(shards), []
    for n in parts:
        total, row = sum(room), []
        for s, free in enumerate(room):
            k = draw_hypergeometric(rng, free, total - free, n)
            row.append(k)
            total, n, room[s] = total - free, n - k, free - k
        matrix.append(row)
    return matrix


def assign_shards(rows: DataFrame, n_shards: int, *, seed: int = 7, max_parts: int = MAX_PARTS,
                  group_rows: int = GROUP_ROWS) -> DataFrame:
    """``rows`` with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Shard sizes differ by one row at most. The driver sees a count for each input partition
    (folded to ``max_parts``), and sends back as many rows of ``n_shards`` numbers. Every
    row counts on its own, whatever its values: repeated rows and nulls are dealt out like
    any others, an empty table gives no rows. Columns named shard or slot are replaced.
    """
    spark = rows.sparkSession
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    kept = stored(rows.select(
        F.struct(*own).alias("row"), F.pmod(F.spark_partition_id(), F.lit(max_parts)).alias("part"),
        F.rand(seed).alias("first"), F.rand(seed + 1).alias("again")), "shard-rows")
    counts = sorted((r["part"], r["n"]) for r in
                    kept.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    bounds = spark.createDataFrame(
        [(part, [sum(row[:s + 1]) for s in range(n_shards - 1)])
         for (part, _), row in zip(counts, matrix, strict=True)],
        "part int, bounds array<long>")
    dealt = (kept.withColumn("rank", F.row_number().over(
        Window.partitionBy("part").orderBy("first", "again")))
        .join(F.broadcast(bounds), "part")
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("rank"))))
        .withColumn("span", F.floor(F.col("again") * max(1, -(-max(sizes) // group_rows)))))
    before = (dealt.groupBy("shard", "span").agg(F.count("*").alias("n"))
              .select("shard", "span", (F.sum("n").over(
                  Window.partitionBy("shard").orderBy("span")) - F.col("n")).alias("before")))
    return (dealt.withColumn("own", F.row_number().over(
        Window.partitionBy("shard", "span").orderBy("again", "first")))
        .join(before, ["shard", "span"])
        .select("row.*", "shard", (F.col("before") + F.col("own") - 1).alias("slot")))
