"""Canonical merchant names: similar names join the most frequent of their kind.

In order of falling frequency each name not yet taken becomes a leader and takes every
untaken name that scores at least the threshold against it. The same grouping is reached
here without visiting names one by one and without comparing all pairs:

* Candidates come from keys. Two names score high only if (a) nearly all of one's text lies
  in words of the other, or (b) few insertions and deletions separate them. For (a) the
  rarest words of one name must meet a word of the other; for (b) the rarest character
  pairs of both must overlap in at least two places. Both rules follow from the threshold
  and lose no pair; every candidate is then scored.
* Names are taken in batches from the top of the order. Inside a batch the leaders are
  found from its similar pairs; then only leaders meet the remaining names, so a crowd of
  near-copies costs one comparison each. Pairs are estimated from key counts before they
  are formed: a batch with more than ``pair_budget`` among its own names is made smaller,
  leaders with more against the rest meet it in several parts.
* A key that many names share is dealt over pieces of either side, so none is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import token_set_score, words_of
from ..runtime import Gathered, broadcast_if_small, compute_once, durable

KEYS_PER_PAIR = 2


def name_counts(rows: DataFrame, name: str = "counterparty_normalized") -> DataFrame:
    return rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))


def ranked_names(names: DataFrame) -> DataFrame:
    """Names with a gapless ``rank`` from 0 (most frequent first, then by name).

    The driver sees one count for each sorted partition.
    """
    ordered = durable(names.orderBy(F.desc("n"), "name").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(ordered.groupBy(part.alias("_part")).agg(F.count("*")).collect())
    starts, total = [], 0
    for number, rows in counts:
        starts.append((number, total))
        total += rows
    starts = names.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    return ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").select(
        "name", "n", (F.col("_start") + F.col("_at") - F.shiftleft("_part", 33)).alias("rank"))


def name_keys(ranked: DataFrame, threshold: float) -> DataFrame:
    """Add ``lkeys`` and ``rkeys``: a pair that can reach the threshold shares an
    ``lkeys`` value of either name with an ``rkeys`` value of the other."""
    c = 1 - threshold / 100
    if not 0 <= c < 1 / 3:
        raise ValueError("the threshold must lie above 66.7 and at most at 100")
    words = words_of(F.col("name"))
    # pairs of neighbouring characters of " word ", numbered where they repeat
    pairs = F.flatten(F.transform("words", lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.concat(F.lit(" "), w, F.lit(" ")).substr(i, F.lit(2)))))
    numbered = F.transform("pairs", lambda x, i: F.concat(
        F.lit("g"), x, F.size(F.filter(F.slice("pairs", 1, i + 1), lambda y: y == x)).cast("string")))
    parts = (
        compute_once(compute_once(ranked.select("rank", "name"), {"words": words}), {"pairs": pairs})
        .select("rank", F.explode(F.concat(
            F.transform("words", lambda w: F.concat(F.lit("w"), w)), numbered)).alias("part"))
    )
    counts = parts.groupBy("part").agg(F.count("*").alias("f"))
    rarest_first = parts.join(counts, "part").groupBy("rank").agg(
        F.array_sort(F.collect_list(F.struct("f", "part"))).alias("parts"))
    sided = compute_once(ranked.join(rarest_first, "rank"), {
        "_words": F.transform(F.filter("parts", lambda p: p["part"].startswith("w")),
                              lambda p: p["part"].substr(F.lit(2), F.length(p["part"]))),
        "_pairs": F.transform(F.filter("parts", lambda p: p["part"].startswith("g")),
                              lambda p: p["part"]),
    })
    sided = compute_once(sided, {"_length": F.length(F.array_join("_words", " "))})
    # (a) words of one side only may fill at most `spare` characters
    spare = (c * (2 * F.col("_length") - 1) - 1) / (1 + c)
    cover = F.filter("_words", lambda w, i: (i == 0) | (
        F.aggregate(F.slice("_words", 1, i), F.lit(0), lambda acc, x: acc + F.length(x)) + i - 1
        <= spare + 1e-9))
    # (b) at most `lost` character pairs differ, so the rarest lost + 2 hold two in common
    lost = F.floor(4 * c * F.col("_length") / (1 + c) + 1e-9).cast("int")
    sided = compute_once(
        sided, {"_cover": cover, "_rare": F.slice("_pairs", 1, lost + KEYS_PER_PAIR)})
    twos = F.flatten(F.transform("_rare", lambda x, i: F.transform(
        F.slice("_rare", i + 2, F.size("_rare")), lambda y: F.xxhash64(F.lit("g"), x, y))))

    def tagged(column: str, tag: str):
        return F.transform(column, lambda w: F.xxhash64(F.lit(tag), w))

    return compute_once(sided, {"_twos": twos}).select(
        "rank", "name",
        F.concat(tagged("_cover", "1"), tagged("_words", "2"), "_twos").alias("lkeys"),
        F.concat(tagged("_words", "1"), tagged("_cover", "2"), "_twos").alias("rkeys"),
    )


def _exploded(names: DataFrame, side: str) -> DataFrame:
    return names.select(F.col("rank").alias(f"{side}_rank"), F.explode(f"{side}keys").alias("key"))


#: names under one key of either side up to which they meet in one piece
LEFT_PIECE, RIGHT_PIECE = 1_000, 10_000


def key_weights(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, l_names, r_names) of the keys that both sides have."""
    a = _exploded(left, "l").groupBy("key").agg(F.count("*").alias("l_names"))
    b = _exploded(right, "r").groupBy("key").agg(F.count("*").alias("r_names"))
    return durable(a.join(b, "key"))


def pair_estimate(weights: DataFrame) -> int:
    """Upper bound of the pairs that ``similar_pairs`` forms, without forming them."""
    return int(weights.agg(F.sum(F.col("l_names") * F.col("r_names"))).first()[0] or 0)


def _dealt(names: DataFrame, side: str, crowded: DataFrame) -> DataFrame:
    """Keys of one side; those of a crowded key lie in one own piece and in all of the other's."""
    other = "r" if side == "l" else "l"
    joined = _exploded(names, side).join(crowded, "key", "left")
    own = F.coalesce(F.pmod(F.xxhash64(f"{side}_rank"), F.col(f"{side}_pieces")), F.lit(0))
    all_of_other = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(f"{other}_pieces"), F.lit(1)) - 1)
    return joined.select(
        f"{side}_rank", "key", own.alias(f"{side}_piece"),
        F.explode(all_of_other).alias(f"{other}_piece"))


def similar_pairs(
    left: DataFrame, right: DataFrame, threshold: float, weights: DataFrame | None = None
) -> DataFrame:
    """(l_rank, r_rank, score) with l_rank before r_rank and a score over the threshold."""
    weights = key_weights(left, right) if weights is None else weights
    crowded = broadcast_if_small(durable(
        weights.filter((F.col("l_names") > LEFT_PIECE) | (F.col("r_names") > RIGHT_PIECE)).select(
            "key", F.ceil(F.col("l_names") / LEFT_PIECE).alias("l_pieces"),
            F.ceil(F.col("r_names") / RIGHT_PIECE).alias("r_pieces"))))
    pairs = (
        _dealt(left, "l", crowded).join(_dealt(right, "r", crowded), ["key", "l_piece", "r_piece"])
        .filter("l_rank < r_rank").select("l_rank", "r_rank").distinct()
    )
    named = (
        pairs.join(left.select(F.col("rank").alias("l_rank"), F.col("name").alias("l_name")), "l_rank")
        .join(right.select(F.col("rank").alias("r_rank"), F.col("name").alias("r_name")), "r_rank")
    )
    scored = token_set_score(named, "l_name", "r_name", at_least=threshold)
    return scored.filter(F.col("score") >= threshold).select("l_rank", "r_rank", "score")


#: similar pairs that one task settles at a time: numbers of 16 MB
LOCAL_PAIRS = 1_000_000


def batch_members(edges: DataFrame) -> DataFrame | None:
    """Names of a batch that some leader takes, from the batch's similar pairs.

    Names are settled from the top of the order, as many at a time as have about
    ``LOCAL_PAIRS`` pairs among themselves; their leaders take what is similar below. Each
    step forgets the pairs of all settled names, so long chains of names cost no more steps.
    All steps add to one table, so their number makes no plan longer.
    """
    def taken_in_order(batches):
        import numpy as np
        import pandas as pd

        parts = [part.to_numpy("int64") for part in batches]
        pairs = np.concatenate(parts) if parts else np.empty((0, 2), "int64")
        pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
        names, at = np.unique(pairs, return_inverse=True)
        leader, name = at.reshape(pairs.shape).T
        taken = bytearray(len(names))
        for i in range(0, len(pairs), 65_536):
            for a, b in zip(leader[i:i + 65_536].tolist(), name[i:i + 65_536].tolist()):
                if not taken[a]:
                    taken[b] = 1
        yield pd.DataFrame({"r_rank": names[np.frombuffer(taken, "uint8") == 1]})

    members = Gathered(edges.sparkSession, "members")
    while (n := edges.count()):
        share = min(1.0, LOCAL_PAIRS / n)
        cut = edges.agg(F.percentile_approx("r_rank", share, 10_000)).first()[0]
        top = edges.filter(F.col("r_rank") <= cut).select("l_rank", "r_rank")
        taken = durable(top.coalesce(1).mapInPandas(taken_in_order, "r_rank bigint"))
        members.add(taken)
        below = edges.filter(F.col("r_rank") > cut)
        reached = durable(
            below.filter(F.col("l_rank") <= cut)
            .join(taken.withColumnRenamed("r_rank", "l_rank"), "l_rank", "left_anti")
            .select("r_rank").distinct())
        members.add(reached)
        edges = durable(
            below.filter(F.col("l_rank") > cut)
            .join(reached.withColumnRenamed("r_rank", "l_rank"), "l_rank", "left_anti")
            .join(reached, "r_rank", "left_anti").select("l_rank", "r_rank"))
    return members.rows() if members.schema else None


def batch_cut(open_names: DataFrame, size: int) -> int | None:
    """Rank below which about ``size`` names are open; null where none is left."""
    width = max(1, size // 4)
    counts = (
        open_names.groupBy(F.floor(F.col("rank") / width).alias("step")).agg(F.count("*").alias("n"))
        .orderBy("step").limit(64).collect())
    taken = 0
    for row in counts:
        taken += row["n"]
        if taken >= size:
            break
    return (row["step"] + 1) * width if counts else None


def canonical_names(
    names: DataFrame, threshold: float = 88.0, batch_rows: int = 20_000,
    max_batch_rows: int = 1_000_000, pair_budget: int = 200_000_000,
) -> DataFrame:
    """(name, n, canonical, score) for names with their counts ``n``."""
    ranked = durable(ranked_names(names))
    open_names = durable(name_keys(ranked, threshold))
    leaders_of = Gathered(names.sparkSession, "leaders")  # (rank, leader, score)
    size = batch_rows
    while True:
        cut = batch_cut(open_names, size)
        if cut is None:
            break
        batch = open_names.filter(F.col("rank") < cut)
        weights = key_weights(batch, batch)
        if size > 1 and pair_estimate(weights) > pair_budget:
            size = max(1, size // 4)
            continue
        edges = durable(similar_pairs(batch, batch, threshold, weights))
        members = batch_members(edges)
        leaders = batch
        if members is not None:
            leaders = durable(batch.join(members.withColumnRenamed("r_rank", "rank"), "rank", "left_anti"))
        rest = open_names.filter(F.col("rank") >= cut)
        reached = edges.join(leaders.select(F.col("rank").alias("l_rank")), "l_rank", "left_semi")
        last = rest.isEmpty()
        if not last:
            weights = key_weights(leaders, rest)
            parts = -(-pair_estimate(weights) // pair_budget)
            if parts == 1:
                reached = reached.unionByName(similar_pairs(leaders, rest, threshold, weights))
            if parts > 1:
                found = Gathered(names.sparkSession, "reached")
                for part in range(parts):
                    some = leaders.filter(F.pmod(F.xxhash64("rank"), F.lit(parts)) == part)
                    found.add(similar_pairs(some, rest, threshold))
                reached = reached.unionByName(found.rows())
        claims = durable(
            reached.groupBy("r_rank").agg(F.min(F.struct("l_rank", "score")).alias("best"))
            .select(F.col("r_rank").alias("rank"), F.col("best.l_rank").alias("leader"),
                    F.col("best.score").alias("score")))
        settled = claims.unionByName(leaders.select(
            "rank", F.col("rank").alias("leader"), F.lit(100.0).alias("score")))
        leaders_of.add(settled)
        if last:
            break
        open_names = durable(rest.join(claims, "rank", "left_anti"))
        size = min(size * 2, max_batch_rows)
    if leaders_of.schema is None:
        return names.select("name", "n", F.col("name").alias("canonical"), F.lit(100.0).alias("score"))
    by_leader = ranked.select(F.col("rank").alias("leader"), F.col("name").alias("canonical"))
    return ranked.join(leaders_of.rows(), "rank").join(by_leader, "leader").select(
        "name", "n", "canonical", "score")
