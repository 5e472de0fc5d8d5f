"""Token-set similarity of two names, 0 to 100.

With I the common words and A', B' the words of one side only, each sorted and joined by
blanks: equal or contained word sets score 100; otherwise the best of A against B, I
against A and I against B counts, each as the share of characters that stay when one text
is edited into the other by insertions and deletions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import compute_once


def words_of(name: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 0)))


#: characters of a text that one 64-bit number holds; the rest is room for the carry
LANE = 62


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda ch: ch != "")


def _low_bits(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - F.lit(1)


def _places(characters: Column, ch: Column) -> Column:
    """Bit i is set where character i is ``ch``."""
    return F.aggregate(
        F.transform(characters, lambda x, i: F.when(
            x == ch, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
            F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda acc, bit: acc.bitwiseOR(bit))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, in code points.

    The bit-vector recurrence: a bit of the row is cleared where the subsequence grows, and
    one addition moves all places of the shorter text on by a character of the longer one.
    Texts of over ``LANE`` characters take several numbers, and the addition carries over.
    """
    first = F.length(a) <= F.length(b)
    x, y = _characters(F.when(first, a).otherwise(b)), _characters(F.when(first, b).otherwise(a))
    n = F.least(F.length(a), F.length(b))

    def step(row: Column, ch: Column) -> Column:
        hit = row.bitwiseAND(_places(x, ch))
        return (row + hit).bitwiseOR(row - hit).bitwiseAND(_low_bits(n))

    short = n - F.bit_count(F.aggregate(y, _low_bits(n), step))

    lanes = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / LANE).cast("int")),
                        lambda i: F.slice(x, i * LANE + 1, F.lit(LANE)))

    def lane_step(state: Column, at: Column, ch: Column) -> Column:
        row, lane = at["row"], at["lane"]
        hit = row.bitwiseAND(_places(lane, ch))
        added = row + hit + state["carry"]
        kept = added.bitwiseOR(row - hit).bitwiseAND(_low_bits(F.size(lane)))
        return F.struct(
            F.concat(state["rows"], F.array(kept)).alias("rows"),
            F.shiftright(added, LANE).alias("carry"))

    def long_step(rows: Column, ch: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("rows"), F.lit(0).cast("bigint").alias("carry"))
        both = F.zip_with(rows, lanes, lambda row, lane: F.struct(row.alias("row"), lane.alias("lane")))
        return F.aggregate(both, start, lambda state, at: lane_step(state, at, ch), lambda state: state["rows"])

    rows = F.aggregate(y, F.transform(lanes, lambda lane: _low_bits(F.size(lane))), long_step)
    long = n - F.aggregate(rows, F.lit(0), lambda acc, row: acc + F.bit_count(row))
    return F.when(n == 0, F.lit(0)).when(n <= LANE, short).otherwise(long)


def indel_distance(a: Column, b: Column) -> Column:
    """Insertions plus deletions that turn one text into the other."""
    return F.length(a) + F.length(b) - 2 * common_subsequence(a, b)


def _share(distance: Column, length: Column) -> Column:
    return F.when(length > 0, 100.0 - 100.0 * distance / length).otherwise(F.lit(100.0))


def token_set_score(pairs: DataFrame, a: str, b: str, at_least: float = 0.0) -> DataFrame:
    """Add ``score`` to pairs of names.

    The edit distance is only computed for pairs that word sets leave open and that can
    still reach ``at_least``: it is never below the Levenshtein distance or the difference
    in length.
    """
    wa, wb = words_of(F.col(a)), words_of(F.col(b))
    out = pairs.withColumns({"_wa": wa, "_wb": wb})
    out = out.withColumns({
        "_i": F.array_join(F.array_intersect("_wa", "_wb"), " "),
        "_da": F.array_join(F.array_except("_wa", "_wb"), " "),
        "_db": F.array_join(F.array_except("_wb", "_wa"), " "),
    })
    li, la, lb = F.length("_i"), F.length("_da"), F.length("_db")
    gap = F.when(li > 0, 1).otherwise(0)
    total = 2 * (li + gap) + la + lb
    blank = (F.size("_wa") == 0) | (F.size("_wb") == 0)
    contained = (li > 0) & ((la == 0) | (lb == 0))
    beside = F.when(li > 0, F.greatest(
        _share(1 + la, 2 * li + 1 + la), _share(1 + lb, 2 * li + 1 + lb))).otherwise(F.lit(0.0))
    # _share >= at_least  <=>  distance <= allowed
    allowed = F.floor((1 - F.lit(at_least / 100.0)) * total + F.lit(1e-9)).cast("int")
    may_reach = (F.abs(la - lb) <= allowed) & (F.levenshtein("_da", "_db") <= allowed)
    out = out.withColumns({
        "_total": total,
        "_known": F.when(blank, F.lit(0.0)).when(contained, F.lit(100.0)),
        "_beside": beside,
    }).withColumn("_open", F.col("_known").isNull() & may_reach)
    # the score is read by filters too: computed once
    out = compute_once(out, {"_distance": F.when(F.col("_open"), indel_distance(F.col("_da"), F.col("_db")))})
    edited = F.when(F.col("_open"), _share(F.col("_distance"), F.col("_total"))).otherwise(F.lit(0.0))
    score = F.coalesce("_known", F.greatest(edited, F.col("_beside")))
    return out.withColumn("score", score).drop(
        "_wa", "_wb", "_i", "_da", "_db", "_total", "_known", "_beside", "_open", "_distance")
