"""Quality rules on whole texts, with repetition found by suffix arrays over words.

A slice of texts gets one suffix array (suffixes of different texts never compare equal).
Neighbours in it give the longest repeat that starts at each word; the words under repeats
of ``min_repeat`` words or more, and the longest of them, decide with the base counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendspark.llm.textarrays import (
    SPACED_WORD, Texts, Words, byte_set, find_words, hash_ranges, hash_windows, mix, spread,
    text_slices, window_starts)

SYMBOL = byte_set(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
NOT_BREAK = byte_set((10, 10), inverse=True)
CONTINUATION = byte_set((0x80, 0xBF))


@dataclass(frozen=True)
class QualityLimits:
    """Base limits, and those of the repetition rule (words and parts of the words)."""

    min_words: int = 50
    repeat_percent: int = 50
    min_repeat: int = 8
    covered_percent: int = 30
    longest_repeat: int = 100


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered",
          "longest_repeat"]
SCHEMA = ("doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
          + ", base_failed boolean, kept boolean")


def _keyed(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mix(values + mix(owner.astype(np.uint64) + np.uint64(1)))


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Flags of entries whose value occurs earlier in ``keys``."""
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    return later


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of entries whose value occurs twice or more."""
    _, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[which] > 1


def longest_repeats(hashes: np.ndarray, owner: np.ndarray, end: np.ndarray,
                    at_least: int) -> np.ndarray:
    """For each word the longest run from there that its text also has elsewhere.

    Runs shorter than ``at_least`` words read 0. ``end`` is the end of the word's text.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    _, word = np.unique(hashes, return_inverse=True)
    key = owner.astype(np.int64) << 32 | word
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int32)  # how many suffixes are smaller, by the words seen so far
    rank[order] = first
    levels = [rank.copy()]
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    width = 1
    while len(active):
        after = active + width
        second = np.where(after < end[active], rank[np.minimum(after, n - 1)].astype(np.int64), -1)
        key = rank[active].astype(np.int64) << 32 | second + 1
        by = np.argsort(key, kind="stable")
        key, active = key[by], active[by]
        at = np.arange(len(active))
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.ones(len(active), bool)
        group[1:] = key[1:] >> 32 != key[:-1] >> 32
        own = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] += (own - np.maximum.accumulate(np.where(group, at, 0))).astype(np.int32)
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        width *= 2
        levels.append(rank.copy())
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    base = min(int(at_least).bit_length() - 1, len(levels) - 1)
    close = (levels[base][a] == levels[base][b]) if (1 << base) <= at_least else a == a
    a, b = a[close], b[close]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        inside = (i < end[a]) & (j < end[b])
        equal = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        common += equal * (1 << k)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    longest[longest < at_least] = 0
    return longest


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def repeat_windows(words: Words, hashes: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Flags of words under windows of ``size`` words that their text has twice or more."""
    begins = np.flatnonzero(window_starts(words, size)[:max(0, len(hashes) - size + 1)])
    keys = _keyed(hash_windows(hashes, size)[begins], owner[begins])
    return spread(begins[_repeated(keys)], size, len(hashes))


def measure(texts: Texts, limits: QualityLimits) -> dict[str, np.ndarray]:
    """Counts of each text of a slice."""
    words = find_words(texts, SPACED_WORD)
    hashes = hash_ranges(texts.data, words.starts, words.ends)
    owner = words.owner()
    end = np.repeat(words.first[1:], np.diff(words.first))
    letters = np.concatenate([[0], np.cumsum(~CONTINUATION[texts.data], dtype=np.int64)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[texts.data], dtype=np.int64)])
    sums = np.concatenate([[0], np.cumsum(letters[words.ends] - letters[words.starts])])

    lines = find_words(texts, NOT_BREAK)
    has_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(
        words.starts, lines.starts)
    line_keys = _keyed(hash_ranges(texts.data, lines.starts, lines.ends), lines.owner())
    again = np.zeros(len(line_keys), bool)
    again[has_word] = _seen_before(line_keys[has_word])

    longest = longest_repeats(hashes, owner, end, limits.min_repeat)
    begins = np.flatnonzero(longest)
    top = np.zeros(len(texts.bounds) - 1, np.int64)
    np.maximum.at(top, owner[begins], longest[begins])
    return {
        "n_words": np.diff(words.first),
        "word_chars": sums[words.first[1:]] - sums[words.first[:-1]],
        "n_symbols": symbols[texts.bounds[1:]] - symbols[texts.bounds[:-1]],
        "n_dup_lines": _per_text(again, lines.first),
        "n_repeat_words": _per_text(repeat_windows(words, hashes, owner, 3), words.first),
        "n_covered": _per_text(spread(begins, longest[begins], len(hashes)), words.first),
        "longest_repeat": top,
    }


def judge(counts: dict[str, np.ndarray], limits: QualityLimits) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the counts."""
    n = counts["n_words"]
    failed = (n < limits.min_words) | (100 * counts["n_repeat_words"] > limits.repeat_percent * n)
    repetitive = ((100 * counts["n_covered"] > limits.covered_percent * n)
                  | (counts["longest_repeat"] > limits.longest_repeat))
    return failed, ~failed & ~repetitive


def score_quality(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """One row per document row: the counts, ``base_failed`` and ``kept``.

    Null or empty text has no words and fails. A null doc_id stays null, repeated rows are
    judged each on their own, other columns are not looked at, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                counts = measure(texts, limits)
                failed, kept = judge(counts, limits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(texts.lo, texts.hi - texts.lo).cast(pa.int64()),
                     *[pa.array(counts[c]) for c in COUNTS], pa.array(failed), pa.array(kept)],
                    names=["doc_id", *COUNTS, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score_quality`` keeps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(measure(texts, limits), limits)[1]
                    for texts in text_slices(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate([*kept, np.zeros(0, bool)])))

    return docs.mapInArrow(run, docs.schema)
