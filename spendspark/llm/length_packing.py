"""Best-fit packing planned over the histogram of lengths.

Documents are tokenised and cut only where they exceed a sequence. The plan never sees a
document: lengths are taken from the longest down, and all pieces of a length go, as counts,
to the sequences with the least room that still holds one. Equal sequences stay together as
runs of numbers, so the plan has the size of the histogram. Each piece then finds its place by
its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendspark.llm.packing import BLANK, LETTER
from spendspark.llm.storage import stored
from spendspark.llm.textarrays import LOWER, hash_ranges, text_slices

CAPACITY = 4096
END_ID = 1
SLICE_BYTES = 1 << 22
CACHE_ENTRIES = 400_000
WORD_END = "</w>"
WORDS_AT_ONCE = 500
#: ranks are counted in groups of about this many pieces of one length
GROUP_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of texts by a tokeniser that joins nothing across words.

    Blanks give no ids and end a word, as any ASCII sign after an ASCII letter does; so the ids
    of a text are those of its chunks, which are encoded once and looked up when met again. New
    words of Latin letters are encoded many at a time: each ends with a token that closes a
    word. Texts that hold a special string go to the tokeniser whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(tokens.values()) + 1, bool)
        self.closes[[i for token, i in tokens.items() if token.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.begin, self.pool = array("q", [0]), array("I")

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(
            [t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, keys: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of new chunks, in a row; ``ends`` says where those of each chunk end."""
        self.place.update(zip(keys, range(len(self.begin) - 1, len(self.begin) - 1 + len(keys)), strict=True))
        self.begin.frombytes((ends + len(self.pool)).astype(np.int64).tobytes())
        self.pool.frombytes(ids.astype(np.uint32).tobytes())

    def _learn_words(self, keys: list[int], words: list[bytes]) -> None:
        runs = [b" ".join(words[i:i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        ids = np.array([i for run in self._ids(runs) for i in run], np.uint32)
        self._learn(keys, ids, np.flatnonzero(self.closes[ids]) + 1)

    def _learn_others(self, keys: list[int], chunks: list[bytes]) -> None:
        each = self._ids(chunks)
        self._learn(keys, np.array([i for ids in each for i in ids], np.uint32),
                    np.cumsum([len(ids) for ids in each]))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where the ids of each text begin."""
        raw = data.tobytes()
        if any(word in raw for word in self.special):
            each = self._ids([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            return (np.array([i for ids in each for i in ids], np.uint32), np.cumsum([0, *map(len, each)]))
        data, starts, ends, pure = word_chunks(data, bounds)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        keys, at, which = np.unique(hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > CACHE_ENTRIES:
            self.forget()
        listed = keys.tolist()
        new = np.array([i for i, k in enumerate(listed) if k not in self.place], np.int64)
        raw = data.tobytes()
        for learn, some in ((self._learn_words, new[pure[at[new]]]), (self._learn_others, new[~pure[at[new]]])):
            if len(some):
                spots = at[some]
                learn(keys[some].tolist(), [raw[a:b] for a, b in zip(
                    starts[spots].tolist(), ends[spots].tolist(), strict=True)])
        slots = np.array([self.place[k] for k in listed], np.int64)
        begin, pool = np.frombuffer(self.begin, np.int64), np.frombuffer(self.pool, np.uint32)
        lengths = (begin[slots + 1] - begin[slots])[which]
        filled = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(begin[slots][which] - filled[:-1], lengths) + np.arange(filled[-1])]
        return ids, filled[np.searchsorted(starts, bounds)]


def latin_letters(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes of the letters from U+00C0 to U+023F, but for the one whose lower case
    is a letter and a mark; U+00D7 and U+00F7 are signs."""
    first = (data >= 0xC3) & (data <= 0xC8)
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    first[:-1] &= (pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)
    first[1:] |= first[:-1]
    return first


def word_chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, whether one word of Latin letters) of the chunks, without blanks.

    ASCII letters come in lower case, as the tokeniser makes them, but for one before a byte
    beyond ASCII: a mark may join it, and not all marks join both cases.
    """
    letter, blank = LETTER[data], BLANK[data]
    wide = data >= 0x80
    low = LOWER[data]
    low[:-1] = np.where(wide[1:], data[:-1], low[:-1])
    cut = np.zeros(len(data), bool)
    cut[1:] = letter[:-1] & ~letter[1:] & ~wide[1:] | (blank[1:] != blank[:-1])
    cut[bounds[bounds < len(data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    letters = np.concatenate([[0], np.cumsum(letter | latin_letters(data))])
    kept = ~blank[starts]
    starts, ends = starts[kept], ends[kept]
    return low, starts, ends, letters[ends] - letters[starts] == ends - starts


@functools.lru_cache(maxsize=1)
def shared_word_encoder(path: str) -> WordEncoder:
    """One for each worker process, whose tasks share what it has learnt; a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def whole_pieces(docs: DataFrame, file: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document: one, or as many full ones as it needs and a rest."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared_word_encoder(file)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for texts in text_slices(batch.column("text"), SLICE_BYTES):
                ids, begin = encode(texts.data, texts.bounds)
                rows = []
                for i in range(texts.hi - texts.lo):
                    own = np.append(ids[begin[i]:begin[i + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity]
                        rows.append((names[texts.lo + i], piece, start, len(part),
                                     zlib.crc32(part.tobytes())))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, pieces a sequence, first sequence, offset).

    The same sequences as best-fit decreasing makes piece by piece: the least room that holds a
    length still is the least after one piece more went in, so it is filled up before the next.
    A row uses up a run of equal sequences or the pieces of a length; runs are split at most
    three times a length, so the number of rows follows from the capacity, not from the counts.
    """
    runs: dict[int, deque[tuple[int, int]]] = {}
    rooms = 0  # bit r: some open sequences have room r
    opened = 0
    plan = []

    def keep(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if n and room:
            runs.setdefault(room, deque()).append((first, n))
            rooms |= 1 << room

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            fitting = rooms >> length
            if not fitting:
                new = -(-left // (capacity // length))
                keep(capacity, opened, new)
                opened += new
                continue
            room = length + (fitting & -fitting).bit_length() - 1
            first, n = runs[room].popleft()
            if not runs[room]:
                rooms &= ~(1 << room)
            each = min(room // length, left)
            used = min(n, left // each)
            plan.append((length, rank, rank + used * each, each, first, capacity - room))
            keep(room, first + used, n - used)
            keep(room - each * length, first, used)
            rank, left = rank + used * each, left - used * each
    return plan


def ranks_by_length(pieces: DataFrame, counts: dict[int, int], group_rows: int) -> DataFrame:
    """Add ``rank``, from 0 among the stored pieces of a length.

    Places in the stored files deal a common length to groups, whatever its rows hold.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("of_length") / group_rows))
    spark = pieces.sparkSession
    sizes = spark.createDataFrame(list(counts.items()), "at long, of_length long")
    dealt = (pieces.withColumn("place", place)
             .join(F.broadcast(sizes), F.col("length") == F.col("at"))
             .withColumn("group", F.pmod(F.xxhash64("place"), groups.cast("long")))
             .drop("at", "of_length"))
    members = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = members.select("length", "group", (F.sum("n").over(
        Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy("place"))
    return (dealt.withColumn("own", own).join(before, ["length", "group"])
            .withColumn("rank", F.col("before") + F.col("own") - 1)
            .drop("place", "group", "own", "before"))


def pack_by_length(docs: DataFrame, *, file: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; only one of more than ``capacity`` ids is cut,
    into full pieces and a rest. Null and empty texts give one piece of one id, a null doc_id
    stays null, repeated rows are packed as often as they occur, an empty table gives no rows,
    other columns are not looked at. The driver sees a count for each length.
    """
    pieces = stored(whole_pieces(
        docs, file or public_tokenizers.path("word_bpe_49k.json"), capacity, end_id), "whole-pieces")
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(
        best_fit(counts, capacity),
        "at long, from_rank long, to_rank long, each long, base long, shift long")
    here = ((F.col("length") == F.col("at")) & (F.col("rank") >= F.col("from_rank"))
            & (F.col("rank") < F.col("to_rank")))
    # at most a few rows for each length up to the capacity
    return (ranks_by_length(pieces, counts, group_rows).join(F.broadcast(plan), here)
            .withColumn("nth", F.col("rank") - F.col("from_rank"))
            .select(*pieces.columns, F.expr("base + nth div each").alias("sequence_id"),
                    F.expr("shift + (nth % each) * length").alias("offset")))
