"""Near-duplicate documents: ProbMinHash, banding, exact verification.

Equal texts count once. Texts that share a band form candidate groups; a group is cut into
tiles of bounded size. In a group of more than one tile every text is first compared with a
few central ones (pivots): those that are similar to one are linked and need no comparison
with each other, so a large group of copies costs as much as its size. Only tiles of
different pivots, or of texts near to none, are then compared with each other. Inside a tile
the signatures tell which pairs can be similar; their shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendspark.llm.components import connected
from spendspark.llm.minhash import band_keys, shingle_sets, signatures, weights
from spendspark.llm.storage import stored
from spendspark.llm.textarrays import text_slices

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 30, 4
TILE = 512
PIVOTS = 8
#: estimates this far under the threshold are six standard deviations off
SLACK = 0.22
SLICE_BYTES = 1 << 21


def text_key(text: str = "text") -> Column:
    """Identity of a text: 16 bytes, computed in the engine."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def text_signatures(docs: DataFrame, *, size: int = SHINGLE) -> DataFrame:
    """doc_id, k (null without words), bands and a byte per component of the signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column("text"), SLICE_BYTES):
                n = texts.hi - texts.lo
                owner, shingles, counts = shingle_sets(texts, size)
                own = signatures(owner, shingles, weights(counts), n, BANDS * ROWS)
                some = np.bincount(owner, minlength=n) > 0
                low = (own & np.uint64(255)).astype(np.uint8)
                key = batch.column("k").slice(texts.lo, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(texts.lo, n).cast(pa.int64()),
                     pa.array([k if s else None for k, s in
                               zip(key.to_pylist(), some.tolist(), strict=True)], pa.binary()),
                     pa.array(list(band_keys(own, BANDS).view(np.int64)), pa.list_(pa.int64())),
                     pa.array([row.tobytes() for row in low], pa.binary())],
                    names=["doc_id", "k", "bands", "low"])

    return docs.select("doc_id", "text", text_key().alias("k")).mapInArrow(
        run, "doc_id long, k binary, bands array<long>, low binary")


def shared_bands(distinct: DataFrame) -> DataFrame:
    """(k, band, n): memberships in bands that more than one text has."""
    each = distinct.select("k", F.explode("bands").alias("band"))
    common = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return stored(each.join(common, "band"), "bands")


def candidate_groups(members: DataFrame) -> DataFrame:
    """(k, g): texts that share bands, directly or through others."""
    first = members.groupBy("band").agg(F.min("k").alias("b"))
    links = members.join(first, "band").select(F.col("k").alias("a"), "b")
    return connected(links).select(F.col("node").alias("k"), F.col("root").alias("g"))


def candidate_sets(docs: DataFrame, chosen: DataFrame, *, size: int = SHINGLE) -> DataFrame:
    """(k, shingles): sorted 64-bit shingles of the texts of ``chosen`` (k, doc_id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column("text"), SLICE_BYTES):
                n = texts.hi - texts.lo
                owner, shingles, _ = shingle_sets(texts, size)
                cut = np.searchsorted(owner, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").slice(texts.lo, n),
                     pa.array([shingles[a:b].tobytes() for a, b in
                               zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    names=["k", "shingles"])

    wanted = chosen.select(F.col("k").alias("k2"), F.col("doc_id").alias("id2"))
    texts = (docs.select("doc_id", "text", text_key().alias("k"))
             .join(wanted, F.expr("k = k2 AND doc_id <=> id2"), "left_semi"))
    return texts.select("k", "text").mapInArrow(run, "k binary, shingles binary").dropDuplicates(["k"])


class _Forest:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[x] = y
        return x != y


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def close_pairs(low: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray,
                similar: float) -> Iterator[tuple[int, int]]:
    """Pairs of ``left`` x ``right`` whose sizes and signatures allow the similarity."""
    need = (similar - SLACK) * low.shape[1]
    for i in left.tolist():
        j = right[(sizes[right] >= similar * sizes[i]) & (sizes[right] * similar <= sizes[i])]
        agree = (low[j] == low[i]).sum(axis=1)
        for other in j[agree >= need].tolist():
            yield i, other


def tile_links(tile: pd.DataFrame, similar: float) -> pd.DataFrame:
    """Links that connect the rows of a tile, one for each merge, between rows of one group.

    Rows of one cluster are connected already; rows of side 0 meet each other and those of
    side 1, if there is a side 1 only the latter.
    """
    keys = tile["k"].tolist()
    low = np.stack([np.frombuffer(x, np.uint8) for x in tile["low"]])
    sets = [np.frombuffer(x, np.uint64) for x in tile["shingles"]]
    sizes = np.array([len(s) for s in sets])
    side = tile["side"].to_numpy()
    forest = _Forest(len(keys))
    first: dict[tuple[bytes, bytes], int] = {}
    for i, (g, c) in enumerate(zip(tile["g"], tile["cluster"], strict=True)):
        if c is not None:
            forest.join(i, first.setdefault((g, c), i))
    found = []
    groups = tile.groupby("g", sort=False).indices.values()
    for rows in groups:
        a, b = rows[side[rows] == 0], rows[side[rows] == 1]
        pairs = close_pairs(low, sizes, a, b, similar) if len(b) else (
            (i, j) for i, j in close_pairs(low, sizes, a, a, similar) if i < j)
        for i, j in pairs:
            if forest.top(i) != forest.top(j) and _similarity(sets[i], sets[j]) >= similar:
                forest.join(i, j)
                found.append((keys[i], keys[j]))
    return pd.DataFrame(found, columns=["a", "b"])


def nearest_pivot(tile: pd.DataFrame, similar: float) -> pd.DataFrame:
    """(k, cluster) for texts of a tile that are similar to a pivot, the most similar one."""
    pivots, rows = tile[tile["side"] == 1], tile[tile["side"] == 0]
    out = []
    marks = [(k, np.frombuffer(s, np.uint64)) for k, s in
             zip(pivots["k"], pivots["shingles"], strict=True)]
    for k, s in zip(rows["k"], rows["shingles"], strict=True):
        own = np.frombuffer(s, np.uint64)
        best, pivot = max((_similarity(own, p), name) for name, p in marks)
        if best >= similar:
            out.append((k, pivot))
    return pd.DataFrame(out, columns=["k", "cluster"])


TILE_COLUMNS = ["g", "k", "cluster", "low", "shingles"]


def verified_links(rows: DataFrame, degrees: DataFrame, similar: float, tile: int) -> DataFrame:
    """Links (a, b) that connect all similar texts of each group. ``rows``: g, k, low, shingles."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    rows = stored(rows.join(sizes, "g"), "grouped")
    tiny = rows.where(F.col("n") <= tile)
    packs = F.lit(max(1, -(-2 * tiny.count() // tile)))
    tiny = tiny.select(F.pmod(F.xxhash64("g"), packs).alias("tile"), "g", "k",
                       F.lit(None).cast("binary").alias("cluster"), "low", "shingles",
                       F.lit(0).alias("side"))

    def links(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return tile_links(pdf, similar)

    def pivot(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return nearest_pivot(pdf, similar)

    found = stored(tiny.groupBy("tile").applyInPandas(links, "a binary, b binary"), "links")
    huge = rows.where(F.col("n") > tile)
    if huge.isEmpty():
        return found

    spread = F.pmod(F.xxhash64("k"), F.ceil(2 * F.col("n") / tile)).alias("block")
    ranked = (huge.select("g", "k").join(degrees, "k").withColumn("place", F.row_number().over(
        Window.partitionBy("g").orderBy(F.desc("degree"), "k"))).where(F.col("place") <= PIVOTS))
    marks = huge.join(ranked.select("g", "k"), ["g", "k"])
    blocks = huge.select("g", spread).distinct()
    seats = (huge.select("g", spread, "k", "shingles", F.lit(0).alias("side"))
             .unionByName(blocks.join(marks, "g").select("g", "block", "k", "shingles",
                                                         F.lit(1).alias("side"))))
    near = stored(seats.groupBy("g", "block").applyInPandas(pivot, "k binary, cluster binary"),
                  "pivots")
    placed = huge.join(near, "k", "left")
    per = placed.groupBy("g", "cluster").agg(F.count("*").alias("m"))
    same = F.expr("p.g = c.g AND p.cluster <=> c.cluster")
    placed = stored(
        placed.alias("p").join(per.alias("c"), same).select(
            "p.*", F.pmod(F.xxhash64("p.k"), F.ceil(2 * F.col("c.m") / tile)).alias("block")),
        "clusters")
    seats = placed.select("g", "cluster", "block").distinct()
    left = seats.select("g", F.col("cluster").alias("c1"), F.col("block").alias("b1"))
    right = seats.select(F.col("g").alias("g2"), F.col("cluster").alias("c2"),
                         F.col("block").alias("b2"))
    order = "(coalesce(c1, X''), b1) <= (coalesce(c2, X''), b2)"
    pairs = (left.join(right, F.expr(f"g = g2 AND {order} AND NOT (c1 <=> c2 AND c1 IS NOT NULL)"))
             .withColumn("tile", F.xxhash64("g", "c1", "b1", "c2", "b2")).drop("g2"))
    one = pairs.select("g", F.col("c1").alias("cluster"), F.col("b1").alias("block"), "tile",
                       F.lit(0).alias("side"))
    two = (pairs.where("NOT (c1 <=> c2 AND b1 = b2)")
           .select("g", F.col("c2").alias("cluster"), F.col("b2").alias("block"), "tile",
                   F.lit(1).alias("side")))
    seated = placed.alias("p").join(one.unionByName(two).alias("c"), F.expr(
        "p.g = c.g AND p.cluster <=> c.cluster AND p.block = c.block")).select(
        "c.tile", *[f"p.{c}" for c in TILE_COLUMNS], "c.side")
    crossing = stored(seated.groupBy("tile").applyInPandas(links, "a binary, b binary"), "links")
    clustered = near.select(F.col("k").alias("a"), F.col("cluster").alias("b"))
    return found.unionByName(crossing).unionByName(clustered)


def near_duplicate_classes(docs: DataFrame, *, similar: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """One row per document row: doc_id, class_id, k (key of its text), class_k (of the class).

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at
    least ``similar``; the class of a document is the smallest doc_id that links reach. Words
    are lower-cased runs of letters and digits; a text of fewer than five is one shingle.
    Texts without words (k null) are alone: their class is their own doc_id. Null doc_ids
    stay null and yield to any other id of their class. Repeated rows are one text and keep a
    row each. Other columns are not looked at; an empty table gives no rows.
    """
    signed = stored(text_signatures(docs), "signatures")
    named = signed.where("k is not null")
    distinct = stored(named.groupBy("k").agg(
        F.first("bands").alias("bands"), F.first("low").alias("low"),
        F.min("doc_id").alias("doc_id")), "texts")
    members = shared_bands(distinct)
    groups = stored(candidate_groups(members), "groups")
    chosen = distinct.drop("bands").join(groups, "k")
    sets = candidate_sets(docs, chosen.select("k", "doc_id"))
    degrees = members.groupBy("k").agg(F.sum("n").alias("degree"))
    links = verified_links(chosen.select("k", "g", "low").join(sets, "k"), degrees, similar, tile)
    roots = connected(links).select(F.col("node").alias("k"), "root")
    classed = distinct.select("k", "doc_id").join(roots, "k", "left").select(
        "k", "doc_id", F.coalesce("root", "k").alias("root"))
    smallest = classed.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("m"))
    of_text = classed.join(smallest, "root").select(
        "k", F.col("m.doc_id").alias("class_id"), F.col("m.k").alias("class_k"))
    alone = signed.where("k is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), "k", F.lit(None).cast("binary").alias("class_k"))
    return (signed.where("k is not null").select("doc_id", "k").join(of_text, "k")
            .select("doc_id", "class_id", "k", "class_k").unionByName(alone))


def keep_one_of_each(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """Rows of ``docs`` with all their columns: of each class the one with the smallest doc_id.

    Texts without words all stay. Rows that repeat a kept one (doc_id and text) go.
    """
    classes = near_duplicate_classes(docs, similar=similar)
    kept = classes.where("k is null OR (k = class_k AND doc_id <=> class_id)")
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("k").alias("__k")).distinct()
    key = F.unhex(F.md5(docs["text"].cast("binary")))
    named = docs.join(kept.where("__k is not null"), docs["doc_id"].eqNullSafe(kept["__id"])
                      & (key == kept["__k"]), "left_semi").dropDuplicates(["doc_id", "text"])
    wordless = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    return named.unionByName(wordless)
