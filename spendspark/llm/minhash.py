"""Signatures of weighted shingles by ProbMinHash.

Each shingle is a Poisson process whose rate is its weight; each of its arrivals falls on one
component of the signature, and a component keeps the shingle that arrives first. The chance
that two texts agree in a component is their probability Jaccard similarity. A shingle stops
once its next arrival is later than the latest of all components; arrivals of all texts of a
slice are drawn together, round by round.
"""

from __future__ import annotations

import numpy as np

from spendspark.llm.textarrays import (
    ITEM_WORD, LOWER, Texts, find_words, hash_ranges, hash_windows, mix)

STEP = np.uint64(0xD1B54A32D192ED03)
WHICH = np.uint64(0x8CB92BA72F3D8DD7)


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, shingles, counts): distinct shingles of each text, in order of the texts.

    A text of fewer words than ``size``, but not none, is one shingle.
    """
    texts = texts._replace(data=LOWER[texts.data])
    words = find_words(texts, ITEM_WORD)
    hashes = hash_ranges(texts.data, words.starts, words.ends)
    n = np.diff(words.first)
    shorter = np.flatnonzero((n > 0) & (n < size))
    inner = np.repeat(words.first[1:], n) - np.arange(int(words.first[-1])) >= size
    begins = np.flatnonzero(inner)
    owner = np.searchsorted(words.first, begins, side="right") - 1
    values = hash_windows(hashes, size)[begins]
    if len(shorter):
        extra = [hash_windows(hashes[words.first[t]:words.first[t + 1]], int(n[t]))[0]
                 for t in shorter]
        owner = np.concatenate([owner, shorter])
        values = np.concatenate([values, np.array(extra, np.uint64)])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return owner[at], values[at], np.diff(np.append(at, len(owner)))


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle weighs 1, and a little more if the text repeats it."""
    return 1.0 + 0.25 * np.log2(counts)


def signatures(owner: np.ndarray, shingles: np.ndarray, weight: np.ndarray, n_texts: int,
               size: int) -> np.ndarray:
    """``n_texts`` rows of ``size`` shingles; rows of texts without shingles are 0."""
    first = np.full(n_texts * size, np.inf)
    winner = np.zeros(n_texts * size, np.uint64)
    latest = np.full(n_texts, np.inf)
    time = np.zeros(len(owner))
    live = np.arange(len(owner))
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(live):
            turn += np.uint64(1)
            draw = mix(shingles[live] + turn * STEP)
            uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
            time[live] -= np.log(uniform) / weight[live]
            live = live[time[live] < latest[owner[live]]]
            component = (mix(shingles[live] ^ (turn * WHICH)) >> np.uint64(33)) % np.uint64(size)
            slot = owner[live] * size + component.astype(np.int64)
            np.minimum.at(first, slot, time[live])
            won = first[slot] == time[live]
            winner[slot[won]] = shingles[live[won]]
            latest = first.reshape(n_texts, size).max(axis=1)
            live = live[time[live] < latest[owner[live]]]
    return winner.reshape(n_texts, size)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)),
                          (len(signature), bands)).copy()
    for j in range(rows):
        out = mix(out + parts[:, :, j])
    return out


def jaccard(owner: np.ndarray, shingles: np.ndarray, n_texts: int) -> np.ndarray:
    """Jaccard similarity of texts 0 and 1, 2 and 3, ..., from their shingle sets."""
    pair = owner // 2
    order = np.lexsort((shingles, pair))
    same = ((pair[order][1:] == pair[order][:-1])
            & (shingles[order][1:] == shingles[order][:-1]))
    common = np.bincount(pair[order][1:][same], minlength=n_texts // 2)
    total = np.bincount(pair, minlength=n_texts // 2) - common
    return common / np.maximum(total, 1)
