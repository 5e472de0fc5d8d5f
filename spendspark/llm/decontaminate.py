"""Benchmark decontamination: a prefix-filtered join of windows with benchmark items.

Every window of an item (13 words, or the whole item if it is shorter) is taken as a set of
shingles of ``shingle`` words, ordered by how often the documents hold them. A document that
contains the window contains its rarest shingle, so that prefix of one shingle is all that is
joined. Its place in the window gives the only start the window can have in the document;
starts whose window does not fit are dropped, the others are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendspark.llm.storage import stored
from spendspark.llm.textarrays import (
    ITEM_WORD, LOWER, Texts, Words, find_words, hash_ranges, hash_windows, spread, text_slices,
    window_starts)

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 2 << 20

SCHEMA = ("doc_id long, th long, n_words long, n_hit long, n_items long, items_sha256 string, "
          "contaminated boolean")


class Windows(NamedTuple):
    """Distinct windows of items: words, their hashes and shingles, and the items they are of."""

    words: list[bytes]
    items: list[list[str]]
    lengths: np.ndarray
    hashes: np.ndarray  # a row per window, padded with 0
    shingles: list[np.ndarray]


def lowered(texts: Texts) -> Texts:
    return texts._replace(data=LOWER[texts.data])


def item_windows(rows: list[tuple[str, str]], window: int, shingle: int) -> Windows:
    """Windows of (item, text) rows; texts without words have none."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for name, text in rows:
        lower = LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()
        w = bytes(b if ITEM_WORD[b] else 32 for b in lower).split()
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i:i + window]), set()).add(name)
    words = [b" ".join(w) for w in found]
    hashes = np.zeros((len(words), window), np.uint64)
    shingles = []
    for k, w in enumerate(found):
        data = np.frombuffer(words[k], np.uint8)
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        own = hash_ranges(data, ends - [len(x) for x in w], ends)
        hashes[k, :len(w)] = own
        shingles.append(hash_windows(own, min(shingle, len(w))))
    return Windows(words, [sorted(x) for x in found.values()],
                   np.array([len(w) for w in found], np.int64), hashes, shingles)


class Members:
    """Look-up of 64-bit values in a sorted set, most of them refused by a table of bits."""

    def __init__(self, values: np.ndarray, bits: int = 20) -> None:
        self.values, self.shift = np.unique(values), np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.values >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``values`` that are members, their numbers in the set)."""
        at = np.flatnonzero(self.table[values >> self.shift])
        if not len(self.values):
            return at[:0], at[:0]
        number = np.minimum(np.searchsorted(self.values, values[at]), len(self.values) - 1)
        hit = self.values[number] == values[at]
        return at[hit], number[hit]


def _word_hashes(texts: Texts) -> tuple[Texts, Words, np.ndarray]:
    texts = lowered(texts)
    words = find_words(texts, ITEM_WORD)
    return texts, words, hash_ranges(texts.data, words.starts, words.ends)


def _shingle_places(words: Words, hashes: np.ndarray, size: int, members: Members):
    at, number = members.find(hash_windows(hashes, size))
    fits = window_starts(words, size)[at] if len(at) else np.zeros(0, bool)
    return at[fits], number[fits]


def shingle_counts(docs: DataFrame, windows: Windows, shingle: int) -> dict[int, int]:
    """How often the documents hold each shingle of the windows (no more rows than those)."""
    by_size = _by_size(windows, shingle)
    members = docs.sparkSession.sparkContext.broadcast(
        {size: Members(np.concatenate(values)) for size, values in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {size: np.zeros(len(m.values), np.int64) for size, m in members.value.items()}
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                _, words, hashes = _word_hashes(texts)
                for size, m in members.value.items():
                    _, number = _shingle_places(words, hashes, size, m)
                    seen[size] += np.bincount(number, minlength=len(m.values))
        for size, m in members.value.items():
            some = np.flatnonzero(seen[size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.values[some].view(np.int64)), pa.array(seen[size][some])],
                names=["shingle", "n"])

    rows = (docs.select("text").mapInArrow(run, "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")).collect())
    return {r["shingle"] & (1 << 64) - 1: r["n"] for r in rows}


def _by_size(windows: Windows, shingle: int) -> dict[int, list[np.ndarray]]:
    out: dict[int, list[np.ndarray]] = {}
    for n, own in zip(windows.lengths.tolist(), windows.shingles, strict=True):
        out.setdefault(min(shingle, n), []).append(own)
    return out


class Probe(NamedTuple):
    """The prefix shingle of each window: windows by shingle, and its place in the window."""

    members: Members
    first: np.ndarray
    window: np.ndarray
    place: np.ndarray


def probes(windows: Windows, counts: dict[int, int], shingle: int) -> dict[int, Probe]:
    """Prefix shingles, by size; windows with a shingle that no document holds are left out."""
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for k, own in enumerate(windows.shingles):
        n, value, place = min((counts.get(v, 0), v, p) for p, v in enumerate(own.tolist()))
        if n:
            chosen.setdefault(min(shingle, int(windows.lengths[k])), []).append((value, k, place))
    out = {}
    for size, rows in chosen.items():
        rows.sort()
        values = np.array([r[0] for r in rows], np.uint64)
        members = Members(values)
        out[size] = Probe(members, np.searchsorted(values, np.append(members.values, values[-1]),
                                                   side="left"),
                          np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        out[size].first[-1] = len(rows)
    return out


def _match(texts: Texts, windows: Windows, prefix: dict[int, Probe]):
    """(words of the texts, flags of hit words, {text: numbers of windows that occur})."""
    texts, words, hashes = _word_hashes(texts)
    total = len(hashes)
    hit = np.zeros(total, bool)
    occurs: dict[int, set[int]] = {}
    for size, probe in prefix.items():
        at, number = _shingle_places(words, hashes, size, probe.members)
        n = probe.first[number + 1] - probe.first[number]
        row = np.repeat(probe.first[number] - np.cumsum(n) + n, n) + np.arange(n.sum())
        w = probe.window[row]
        start, length = np.repeat(at, n) - probe.place[row], windows.lengths[w]
        owner = np.searchsorted(words.first, np.repeat(at, n), side="right") - 1
        fits = (start >= words.first[owner]) & (start + length <= words.first[owner + 1])
        w, start, length, owner = w[fits], start[fits], length[fits], owner[fits]
        for j in range(windows.hashes.shape[1]):
            same = (j >= length) | (hashes[np.minimum(start + j, total - 1)] == windows.hashes[w, j])
            w, start, length, owner = w[same], start[same], length[same], owner[same]
        exact = np.ones(len(w), bool)
        for i, (k, s, n_words) in enumerate(zip(w.tolist(), start.tolist(), length.tolist(),
                                                strict=True)):
            a, b = words.starts[s:s + n_words].tolist(), words.ends[s:s + n_words].tolist()
            base = a[0]
            raw = texts.data[base:b[-1]].tobytes()
            exact[i] = windows.words[k] == b" ".join(
                raw[x - base:y - base] for x, y in zip(a, b, strict=True))
        hit |= spread(start[exact], length[exact], total)
        for t, k in zip(owner[exact].tolist(), w[exact].tolist(), strict=True):
            occurs.setdefault(t, set()).add(k)
    return words, hit, occurs


def _item_blocks(benchmark: DataFrame, block: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """Items with text in blocks of about ``block`` bytes, and whether it is the last one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = max(1, -(-size // block))
    for k in range(spans):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(spans)) == k)
        yield [(r["item"] or "", r["text"]) for r in part.collect()], k == spans - 1


def find_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW,
                      shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated.

    ``th`` is a hash of the text.

    Benchmarks of any size are taken in blocks of about ``block_bytes``, the only thing that
    is broadcast; results are the same for every block size. Null or empty text has no words
    and no hits; items without words match nothing; a null item_id reads as the empty string;
    items with one id count once; repeated document rows are judged each on their own; other
    columns are not looked at.
    """
    state = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", F.array().cast("array<long>").alias("hits"),
                        F.array().cast("array<string>").alias("items"))
    for rows, last in _item_blocks(benchmark, block_bytes):
        windows = item_windows(rows, window, shingle)
        prefix = probes(windows, shingle_counts(docs, windows, shingle), shingle)
        if last:
            return _matched(state, windows, prefix, SCHEMA, _judged)
        state = stored(_matched(state, windows, prefix, STATE, _carried), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated.

    Rows are told apart by doc_id and text, so equal rows go or stay together.
    """
    bad = find_contaminated(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"])
                     & (F.xxhash64(docs["text"]) == bad["__th"]), "left_anti")


STATE = "doc_id long, th long, text string, hits array<long>, items array<string>"


def _carried(own: pa.RecordBatch, words: Words, hits: list, items: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [own.column("doc_id").cast(pa.int64()), own.column("th"), own.column("text"),
         pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
        names=["doc_id", "th", "text", "hits", "items"])


def _judged(own: pa.RecordBatch, words: Words, hits: list, items: list) -> pa.RecordBatch:
    n_words, n_hit = np.diff(words.first), np.array([len(x) for x in hits], np.int64)
    return pa.RecordBatch.from_arrays(
        [own.column("doc_id").cast(pa.int64()), own.column("th"), pa.array(n_words), pa.array(n_hit),
         pa.array([len(x) for x in items], pa.int64()),
         pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
         pa.array((n_hit > 0) & (20 * n_hit >= n_words))],
        names=["doc_id", "th", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _matched(state: DataFrame, windows: Windows, prefix: dict[int, Probe], schema: str,
             finish) -> DataFrame:
    """Add the hit words and the items found with one block to the earlier ones."""
    known = state.sparkSession.sparkContext.broadcast((windows, prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                own = batch.slice(texts.lo, texts.hi - texts.lo)
                words, hit, occurs = _match(texts, *known.value)
                hits, items = own.column("hits").to_pylist(), own.column("items").to_pylist()
                for t, found in occurs.items():
                    a, b = words.first[t], words.first[t + 1]
                    hits[t] = sorted({*hits[t], *np.flatnonzero(hit[a:b]).tolist()})
                    items[t] = sorted({*items[t], *(x for k in found
                                                    for x in known.value[0].items[k])})
                yield finish(own, words, hits, items)

    return state.mapInArrow(run, schema)
