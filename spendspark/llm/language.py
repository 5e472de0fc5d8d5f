"""Language of words and texts by a linear-chain conditional random field.

A word speaks through its affixes, its character n-grams and itself (hashed features);
learned transitions tie neighbours together; forward-backward gives each word's chance of
each language. The language of a text is the one with the largest mean chance over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendspark.llm.textarrays import (
    LOWER, Texts, Words, byte_set, find_words, hash_ranges, mix, range_hasher, text_slices)

LETTERS = byte_set((65, 90), (97, 122), (0x80, 0xFF))
ASCII_LETTERS = byte_set((65, 90), (97, 122))
SLICE_BYTES = 1 << 21
UNDETERMINED = "und"


class Settings(NamedTuple):
    """Bounds of the sample that the field is fitted on, and of the fit.

    Per language at most ``texts`` texts, the first by a hash of their id, and of these at
    most ``chains`` runs of ``chain`` words, drawn from all over the texts.
    """

    texts: int = 300
    chains: int = 1200
    chain: int = 24
    features: int = 1 << 16
    passes: int = 3
    batch: int = 96
    rate: float = 0.3
    shrink: float = 1e-5


class Field(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # a row per hashed feature, a column per language
    first: np.ndarray
    steps: np.ndarray  # from a row's language to a column's


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                  size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs: the word, prefixes to 3, suffixes to 4, n-grams of 2 and 3 bytes."""
    words, found = [], []
    every, hashed = np.arange(len(starts)), range_hasher(data)

    def add(kind: int, which: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        words.append(which)
        h = mix(hashed(a, b) + np.uint64(kind))
        found.append((h % np.uint64(size)).astype(np.int64))

    add(1, every, starts, ends)
    for n in (1, 2, 3):
        some = every[ends - starts >= n]
        add(10 + n, some, starts[some], starts[some] + n)
    for n in (1, 2, 3, 4):
        some = every[ends - starts >= n]
        add(20 + n, some, ends[some] - n, ends[some])
    for n in (2, 3):
        room = np.maximum(ends - starts - n + 1, 0)
        which = np.repeat(every, room)
        at = starts[which] + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        add(30 + n, which, at, at + n)
    return np.concatenate(words), np.concatenate(found)


def emissions(weights: np.ndarray, word: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(word, weights=weights[feature, k], minlength=n)
                     for k in range(weights.shape[1])], axis=1)


def posteriors(scores: np.ndarray, first: np.ndarray, field_first: np.ndarray,
               steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``scores`` holds the words of all chains in a row, ``first`` where each chain begins.
    Returns each word's chances and, per pair of languages, the expected transitions.
    """
    n_words, n_lang = scores.shape
    out = np.zeros_like(scores)
    moves = np.zeros((n_lang, n_lang))
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    if n_words == 0:
        return out, moves
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(steps - steps.max())
    start = np.exp(field_first - field_first.max())
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    ahead = np.zeros_like(scores)
    a = np.zeros((len(begin), n_lang))
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        a = (a[:n] @ step if t else np.broadcast_to(start, (n, n_lang))) * local[at]
        a /= a.sum(axis=1, keepdims=True)
        ahead[at] = a
    back = np.ones((len(begin), n_lang))
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        p = ahead[at] * back[:n]
        out[at] = p / p.sum(axis=1, keepdims=True)
        if t:
            b = local[at] * back[:n]
            pair = ahead[at - 1][:, :, None] * step * b[:, None, :]
            moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ step.T
            back[:n] = b / b.sum(axis=1, keepdims=True)
    return out, moves


def letter_words(texts: Texts) -> tuple[Texts, Words]:
    texts = texts._replace(data=LOWER[texts.data])
    return texts, find_words(texts, LETTERS)


def has_letter(texts: Texts) -> np.ndarray:
    """Whether each text has a letter of any script."""
    plain = np.concatenate([[0], np.cumsum(ASCII_LETTERS[texts.data], dtype=np.int64)])
    found = plain[texts.bounds[1:]] > plain[texts.bounds[:-1]]
    for t in np.flatnonzero(~found).tolist():
        raw = texts.data[texts.bounds[t]:texts.bounds[t + 1]].tobytes()
        found[t] = any(c.isalpha() for c in raw.decode("utf-8", "ignore"))
    return found


def fit_field(rows: list[tuple[str, str]], settings: Settings) -> Field | None:
    """Fit on (text, language) rows by adaptive gradient steps on the chains' likelihood."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng = np.random.default_rng(5)
    texts = Texts(0, len(rows), np.frombuffer(b"".join(t.encode() for t, _ in rows), np.uint8),
                  np.cumsum([0, *(len(t.encode()) for t, _ in rows)]))
    texts, words = letter_words(texts)
    labels = np.array([languages.index(lang) for _, lang in rows])
    chains = []
    for k in range(len(languages)):
        own = [(i, min(i + settings.chain, int(words.first[t + 1])), k)
               for t in np.flatnonzero(labels == k)
               for i in range(int(words.first[t]), int(words.first[t + 1]), settings.chain)]
        chains += [own[i] for i in rng.permutation(len(own))[:settings.chains]]
    places = np.concatenate([np.arange(a, b) for a, b, _ in chains] + [np.zeros(0, np.int64)])
    word, feature = word_features(texts.data, words.starts[places], words.ends[places],
                                  settings.features)
    feature = feature[np.argsort(word, kind="stable")]
    of_word = np.cumsum([0, *np.bincount(word, minlength=len(places))])  # features by word
    of_chain = np.cumsum([0, *(b - a for a, b, _ in chains)])  # words by chain
    labels = np.array([k for *_, k in chains], np.int64)
    n_lang = len(languages)
    weights, seen = np.zeros((settings.features, n_lang)), np.full((settings.features, n_lang), 1e-8)
    first, steps = np.zeros(n_lang), np.zeros((n_lang, n_lang))
    first_seen, steps_seen = np.full(n_lang, 1e-8), np.full((n_lang, n_lang), 1e-8)

    def climb(value: np.ndarray, sums: np.ndarray, gradient: np.ndarray) -> None:
        sums += gradient * gradient
        value += settings.rate * gradient / np.sqrt(sums)

    for _ in range(settings.passes):
        order = rng.permutation(len(chains))
        for lo in range(0, len(order), settings.batch):
            part = order[lo:lo + settings.batch]
            index = np.concatenate([np.arange(of_chain[i], of_chain[i + 1]) for i in part])
            bounds = np.cumsum([0, *(of_chain[part + 1] - of_chain[part])])
            truth = np.zeros((len(index), n_lang))
            truth[np.arange(len(index)), np.repeat(labels[part], np.diff(bounds))] = 1
            n = of_word[index + 1] - of_word[index]
            word = np.repeat(np.arange(len(index)), n)
            feature_now = feature[np.repeat(of_word[index] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            chance, moves = posteriors(emissions(weights, word, feature_now, len(index)), bounds,
                                       first, steps)
            delta = (truth - chance) / len(part)
            gradient = np.stack([np.bincount(feature_now, weights=delta[word, k],
                                             minlength=settings.features)
                                 for k in range(n_lang)], axis=1)
            climb(weights, seen, gradient - settings.shrink * weights)
            climb(first, first_seen, delta[bounds[:-1]].sum(axis=0))
            stays = np.bincount(labels[part], weights=np.diff(bounds) - 1, minlength=n_lang)
            climb(steps, steps_seen, (np.diag(stays) - moves) / len(part) - 0.01 * steps)
    return Field(languages, weights, first, steps)


def word_chances(texts: Texts, field: Field) -> tuple[Words, np.ndarray]:
    """Words of a slice and each one's chance of each language."""
    texts, words = letter_words(texts)
    keys = hash_ranges(texts.data, words.starts, words.ends)
    _, at, which = np.unique(keys, return_index=True, return_inverse=True)
    word, feature = word_features(texts.data, words.starts[at], words.ends[at], len(field.weights))
    scores = emissions(field.weights, word, feature, len(at))[which]
    return words, posteriors(scores, words.first, field.first, field.steps)[0]


def learning_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """The sample (text, lang): labelled texts outside the held-out fifth of the ids."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text")
    return (docs.where("lang IS NOT NULL AND text IS NOT NULL AND NOT " + HELD_OUT)
            .select("doc_id", "text", "lang")
            .withColumn("place", F.row_number().over(first)).where(F.col("place") <= settings.texts)
            .select("text", "lang"))


HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, true)"


def learn_languages(docs: DataFrame, settings: Settings = Settings()) -> Field | None:
    """The field of the labelled texts of ``docs``; none if no text is labelled."""
    rows = learning_rows(docs, settings).collect()
    return fit_field(sorted((r["text"], r["lang"]) for r in rows), settings)


def detect_languages(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score, runs.

    ``runs`` are stretches of words of one language: number of the first word, of words,
    language. Null text, text without a letter, and all texts without a field are ``und`` with
    score 0 and no runs. A null doc_id counts as held out; repeated rows are judged alike;
    other columns are not looked at.
    """
    known = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = known.value
        for batch in batches:
            for texts in text_slices(batch.column("text"), SLICE_BYTES):
                n = texts.hi - texts.lo
                names, scores, runs = [UNDETERMINED] * n, np.zeros(n), [[] for _ in range(n)]
                if field:
                    words, chances = word_chances(texts, field)
                    sums = np.concatenate([np.zeros((1, chances.shape[1])),
                                           np.cumsum(chances, axis=0)])
                    count = np.diff(words.first)
                    mean = ((sums[words.first[1:]] - sums[words.first[:-1]])
                            / np.maximum(count, 1)[:, None])
                    best, spoken = mean.argmax(axis=1), has_letter(texts) & (count > 0)
                    of_word = chances.argmax(axis=1)
                    turn = np.ones(len(of_word) + 1, bool)
                    turn[1:-1] = of_word[1:] != of_word[:-1]
                    turn[words.first] = True
                    at = np.flatnonzero(turn)
                    owner = np.searchsorted(words.first, at[:-1], side="right") - 1
                    for t, a, b in zip(owner.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                        if spoken[t]:
                            runs[t].append({"word": a - int(words.first[t]), "words": b - a,
                                            "lang": field.languages[of_word[a]]})
                    for t in np.flatnonzero(spoken).tolist():
                        names[t], scores[t] = field.languages[best[t]], min(1.0, mean[t, best[t]])
                own = batch.slice(texts.lo, n)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id").cast(pa.int64()), own.column("held_out"),
                     pa.array(names, pa.string()), pa.array(scores), pa.array(runs, RUNS)],
                    names=["doc_id", "held_out", "lang_pred", "score", "runs"])

    return docs.select("doc_id", "text", F.expr(HELD_OUT).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, "
             "runs array<struct<word: long, words: long, lang: string>>")


RUNS = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
