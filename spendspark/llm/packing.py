"""Packing of token pieces into sequences by minimum bin slack.

Documents are tokenised and cut into full pieces and one rest each. Only how often each
length occurs matters for filling: a subset-sum over bitsets picks the multiset of lengths
that comes closest to the capacity, and the same multiset is used as often as the counts
allow. The plan is as large as the number of lengths, not of documents; pieces find their
place in it by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendspark.llm.storage import stored
from spendspark.llm.textarrays import byte_set, hash_ranges, text_slices

END_ID = 0
CACHE_ENTRIES = 400_000
SLICE_BYTES = 1 << 22
RANK_GROUP_ROWS = 500_000

LETTER = byte_set((65, 90), (97, 122))
BLANK = byte_set((0x20, 0x20), (0x09, 0x0D))
SPECIAL = b"<|endoftext|>"

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _wide_blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a Unicode space of two or three bytes ends just before each place."""
    a, b, c = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    three = ((c == 0xE1) & (b == 0x9A) & (a == 0x80)
             | (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
             | (c == 0xE2) & (b == 0x81) & (a == 0x9F) | (c == 0xE3) & (b == 0x80) & (a == 0x80))
    return two | three


def cut_points(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places where a byte-level tokeniser never joins what stands on both sides.

    These are ends of ASCII words, blanks after anything but a blank, and ends of texts.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64)
    letter, blank = LETTER[data], BLANK[data]
    ascii_next = data[1:] < 0x80
    cut = np.zeros(len(data), bool)
    cut[1:] = letter[:-1] & ~letter[1:] & ascii_next | blank[1:] & ~blank[:-1]
    doubtful = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
    cut[doubtful[_wide_blank_before(data, doubtful)]] = False
    cut[bounds[bounds < len(data)]] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Token ids of texts, from the ids of their chunks; chunks met again are looked up.

    A new chunk is encoded from the ranks of the same vocabulary, which gives the same ids
    in a third of the time. Texts that hold the special string go to the tokeniser itself.
    """

    def __init__(self, path: str, ranks_path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode_chunk = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.begin, self.pool = array("q", [0]), array("I")

    def _learn(self, keys: list[int], chunks: list[bytes]) -> None:
        for key, chunk in zip(keys, chunks, strict=True):
            self.place[key] = len(self.begin) - 1
            self.pool.extend(self.encode_chunk(chunk.decode()))
            self.begin.append(len(self.pool))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where the ids of each text begin."""
        if SPECIAL in data.tobytes():
            raw = data.tobytes()
            each = [np.array(self.tokenizer.encode(
                raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.cumsum(
                [0, *map(len, each)])
        starts = cut_points(data, bounds)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, at, which = np.unique(
            hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > CACHE_ENTRIES:
            self.forget()
        listed = keys.tolist()
        new = [i for i, k in enumerate(listed) if k not in self.place]
        raw = data.tobytes()
        if new:
            spots = at[new]
            self._learn([listed[i] for i in new],
                        [raw[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist(),
                                                  strict=True)])
        slots = np.array([self.place[k] for k in listed], np.int64)
        begin = np.frombuffer(self.begin, np.int64)
        pool = np.frombuffer(self.pool, np.uint32)
        lengths = (begin[slots + 1] - begin[slots])[which]
        filled = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(begin[slots][which] - filled[:-1], lengths) + np.arange(filled[-1])]
        return ids, filled[np.searchsorted(starts, bounds)]


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str, ranks_path: str) -> ChunkEncoder:
    """One for each worker process, whose tasks share what it has learnt."""
    return ChunkEncoder(path, ranks_path)


def tokenizer_files() -> tuple[str, str]:
    """The tokeniser and the ranks of its vocabulary."""
    return (public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_pieces(docs: DataFrame, files: tuple[str, str], capacity: int,
                 with_ids: bool) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document; the last one holds the rest.

    A document is its token ids and the id 0. Null text counts as empty. Rows are taken as
    they come: repeated rows give repeated pieces.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared_encoder(*files)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for texts in text_slices(batch.column("text"), SLICE_BYTES):
                ids, begin = encode(texts.data, texts.bounds)
                rows = []
                for i in range(texts.hi - texts.lo):
                    own = np.append(ids[begin[i]:begin[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(own), capacity):
                        part = own[start:start + capacity].tobytes()
                        rows.append((names[texts.lo + i], start, len(part) // 4,
                                     zlib.crc32(part), len(own), part if with_ids else None))
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to ``room``.

    Bit ``s`` of the set says that the sum ``s`` can be reached; the states of the set, one
    for each doubling of a length, lead back to the counts.
    """
    mask, reach, states = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            states.append((length, take, reach))
            reach |= reach << length * take & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(states):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def fill_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, pieces a sequence, first sequence, offset).

    The longest length left opens a sequence, the closest fill closes it.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    used: dict[int, int] = {}
    plan, sequence = [], 0
    while left:
        largest = max(left)
        rest = {k: n - (k == largest) for k, n in left.items()}
        pattern = closest_fill({k: n for k, n in rest.items() if n}, capacity - largest)
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for k in sorted(pattern, reverse=True):
            n, begin = pattern[k], used.get(k, 0)
            plan.append((k, begin, begin + n * times, n, sequence, offset))
            used[k], offset = begin + n * times, offset + k * n
            left[k] -= n * times
            if not left[k]:
                del left[k]
        sequence += times
    return plan


def assign_sequences(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to stored pieces.

    The driver sees one count for each length, at most ``capacity`` of them. Ranks within a
    length come from groups of bounded size, so a common length does not meet in one task.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = fill_plan(counts, capacity)
    places = spark.createDataFrame(
        plan, "at_length long, from_rank long, to_rank long, each long, base long, shift long")
    spans = max(1, -(-sum(counts.values()) // RANK_GROUP_ROWS))
    grouped = pieces.withColumn("span", F.pmod(
        F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(spans)).cast("int"))
    sizes = (grouped.groupBy("length", "span").agg(F.count("*").alias("n"))
             .select("length", "span", (F.sum("n").over(
                 Window.partitionBy("length").orderBy("span")) - F.col("n")).alias("before")))
    ranked = (grouped.withColumn("own", F.row_number().over(
        Window.partitionBy("length", "span").orderBy("doc_id", "start", "ids_crc32")))
        .join(sizes, ["length", "span"])
        .withColumn("rank", F.col("before") + F.col("own") - 1))
    return (ranked.join(F.broadcast(places), (F.col("length") == F.col("at_length"))
                        & (F.col("rank") >= F.col("from_rank"))
                        & (F.col("rank") < F.col("to_rank")))
            .withColumn("nth", F.col("rank") - F.col("from_rank"))
            .withColumn("sequence_id", F.expr("base + nth div each"))
            .withColumn("offset", F.expr("shift + (nth % each) * length"))
            .select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, *, files: tuple[str, str] | None = None,
                   capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the ids (little-endian, 32 bits each). An empty table gives none; null
    or empty text gives one piece holding the id 0; a null doc_id stays null; repeated rows
    are packed as often as they occur; other columns are not looked at.
    """
    pieces = token_pieces(docs, files or tokenizer_files(), capacity, with_ids)
    kept = stored(pieces if with_ids else pieces.drop("ids"), "pieces")
    return assign_sequences(kept, capacity)


def token_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids, length (pad to the capacity when fed).

    Takes the rows of ``pack_documents(..., with_ids=True)``; each group is one sequence.
    """
    return (packed.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
                 F.sum("length").alias("length"))
            .select("sequence_id", F.expr(
                "aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"), "length"))
