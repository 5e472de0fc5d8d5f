"""Chat formatting of reply trees.

Messages point to the message they answer. Self-joins that double the distance of each
pointer give every message its distance from the root and the score of the way there; the
leaves, ranked by score, name the branches; going back through the same pointers lists the
messages of the chosen ones. A branch becomes one text with a mask of what the loss sees.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendspark.llm.storage import stored

OPEN, CLOSE, END, BEGIN = "<|", "|>\n", "<|end|>\n", "<s>"
#: the escape sign first; no mark of the template can be written without one of the others
ESCAPED = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPED):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _joined(a: DataFrame, b: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """Rows of ``a`` with those of ``b`` in the same tree whose ``right`` is their ``left``."""
    other = b.withColumnsRenamed({"conv_id": "tree", right: "at"})
    return a.join(other, F.expr(f"conv_id <=> tree AND {left} = at"), how).drop("tree", "at")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def branch_messages(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Messages of the ``keep`` best branches of each tree: conv_id, leaf, msg_id, back.

    ``messages`` has conv_id, msg_id (unique in it), parent_id and score. ``back`` counts from
    the leaf. A branch is worth the sum of its scores (null: 0); longer ones, then smaller
    leaf ids come first among equals. A parent that is missing makes a root; messages without
    id and those in a cycle are on no branch; of a repeated id the smallest row counts.
    """
    nodes = (messages.where("msg_id is not null").groupBy("conv_id", "msg_id")
             .agg(F.min(F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score")))
                  .alias("m")).select("conv_id", "msg_id", "m.*"))
    parents = nodes.select("conv_id", F.col("msg_id").alias("known"), F.col("msg_id").alias("up"))
    state = stored(_joined(nodes, parents, "parent_id", "known", "left")
                   .select("conv_id", "msg_id", "up", F.col("score").alias("total"),
                           F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("dist")),
                   "tree")
    ended = [state.where("up is null")]
    jumps = [state.where("up is not null")]
    left = jumps[0].count()
    while left:
        known = _all(ended).unionByName(jumps[-1])
        farther = known.select("conv_id", F.col("msg_id").alias("known"), F.col("up").alias("next"),
                               F.col("dist").alias("more"), F.col("total").alias("plus"))
        state = stored(_joined(jumps[-1], farther, "up", "known").select(
            "conv_id", "msg_id", F.col("next").alias("up"), (F.col("total") + F.col("plus")).alias("total"),
            (F.col("dist") + F.col("more")).alias("dist")), "tree")
        ended.append(state.where("up is null"))
        before, left = left, state.where("up is not null").count()
        if left == before and 2 ** len(jumps) > left:  # only cycles are left
            break
        jumps.append(state.where("up is not null"))
    answered = jumps[0].select("conv_id", F.col("up").alias("known")).distinct()
    leaves = _joined(_all(ended), answered, "msg_id", "known", "left_anti")
    best = (leaves.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(
        F.desc("total"), F.desc("dist"), "msg_id"))).where(F.col("place") <= keep))
    path = best.select("conv_id", F.col("msg_id").alias("leaf"), F.col("msg_id"),
                       F.lit(0).cast("long").alias("back"))
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].select("conv_id", F.col("msg_id").alias("known"), "up")
        path = stored(path, "branch") if k % 4 == 3 else path
        path = path.unionByName(_joined(path, up, "msg_id", "known").select(
            "conv_id", "leaf", F.col("up").alias("msg_id"), (F.col("back") + 2 ** k).alias("back")))
    return path


def format_branches(messages: DataFrame, *, keep: int = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen branch: conv_id, leaf, formatted, masked.

    ``masked`` lists the runs that count for the loss, the texts of ``loss_role``: the turn,
    how many code points of its part of the text stand before the run, its place in the whole
    text, its length. Null roles and texts read as empty. A branch is one text, so its turns
    meet in one task; different branches do not.
    """
    spoken = (messages.where("msg_id is not null").groupBy("conv_id", "msg_id")
              .agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"),
                                  F.coalesce("text", F.lit("")).alias("text"))).alias("m")))
    path = branch_messages(messages, keep)
    turns = (_joined(path, spoken, "msg_id", "msg_id")
             .select("conv_id", "leaf", "back", F.col("m.role").alias("role"),
                     F.concat(F.lit(OPEN), escaped(F.col("m.role")), F.lit(CLOSE)).alias("head"),
                     escaped(F.col("m.text")).alias("body")))
    order = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("back"))
    placed = (turns
              .withColumn("turn", F.row_number().over(order))
              .withColumn("skip", F.length("head"))
              .withColumn("piece", F.concat("head", "body", F.lit(END)))
              .withColumn("at", F.sum(F.length("piece").cast("long")).over(order)
                          - F.length("piece") + F.lit(len(BEGIN))))
    run = F.struct("turn", "skip", (F.col("at") + F.col("skip")).alias("at"),
                   F.length("body").alias("length"))
    return (placed.groupBy("conv_id", "leaf")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("pieces"),
                 F.array_sort(F.collect_list(F.when(F.col("role") == loss_role, run)))
                 .alias("masked"))
            .select("conv_id", "leaf", F.concat(F.lit(BEGIN), F.array_join("pieces.piece", ""))
                    .alias("formatted"), "masked"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts out of ``formatted`` and ``masked``: adds turns, loss_texts."""
    pieces = F.slice(F.col("pieces"), 1, F.size("pieces") - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\|>\n", 2)
        return F.struct(unescaped(F.substring(F.get(parts, 0), len(OPEN) + 1, 2 ** 31 - 1))
                        .alias("role"), unescaped(F.get(parts, 1)).alias("text"))

    return (formatted
            .withColumn("pieces", F.split(F.expr(f"substring(formatted, {len(BEGIN) + 1})"),
                                          r"<\|end\|>\n"))
            .withColumn("turns", F.transform(pieces, turn))
            .withColumn("loss_texts", F.transform("masked", lambda m: unescaped(
                F.substr(F.get(F.col("pieces"), m["turn"] - 1), m["skip"] + 1, m["length"]))))
            .drop("pieces"))


def linear_messages(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages, each an answer to the one before.

    Rows of one turn follow each other by role and text; a null turn comes first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long")
                         .alias("msg_id"))
            .withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))
            .withColumn("score", F.lit(1.0)))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` finds in formatted conversations."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
