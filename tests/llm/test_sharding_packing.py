from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spendspark.llm.packing import (
    ChunkEncoder, closest_fill, fill_plan, pack_documents, token_sequences, tokenizer_files)
from spendspark.llm.queries import QUERIES
from spendspark.llm.sharding import assign_shards, communication_matrix, draw_hypergeometric
from spendspark.llm.textarrays import text_slices

SF = "/root/testdata/sf0.001"


def test_hypergeometric_law():
    rng, good, bad, draws, n = random.Random(3), 9, 14, 8, 30_000
    seen = Counter(draw_hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(9):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_hypergeometric_edges():
    rng = random.Random(1)
    assert draw_hypergeometric(rng, 0, 5, 3) == 0 and draw_hypergeometric(rng, 5, 0, 3) == 3
    assert draw_hypergeometric(rng, 5, 5, 10) == 5 and draw_hypergeometric(rng, 5, 5, 0) == 0
    big = draw_hypergeometric(rng, 10 ** 11, 23 * 10 ** 11, 4 * 10 ** 6)
    assert abs(big - 4e6 / 24) < 6 * math.sqrt(4e6 / 24)


def test_matrix_sums():
    parts, shards = [5, 0, 17, 30], [18, 17, 17]
    m = communication_matrix(parts, shards, 4)
    assert [sum(r) for r in m] == parts and [sum(c) for c in zip(*m, strict=True)] == shards


def test_shards_are_even_and_gapless(spark, messy):
    rows = messy.select("doc_id", "text", "shard", "row").unionByName(
        messy.select("doc_id", "text", "shard", "row")).repartition(5)
    out = assign_shards(rows, 4, group_rows=3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(
        (r["doc_id"], r["text"]) for r in rows.collect())
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert assign_shards(rows.limit(0), 4).count() == 0


def test_shuffle_is_uniform(spark):
    rows = spark.range(0, 1200, 1, 6)
    out = assign_shards(rows, 6, seed=11).collect()
    seen = Counter((r["id"] // 200, r["shard"]) for r in out)
    chi = sum((seen[p, s] - 200 / 6) ** 2 / (200 / 6) for p in range(6) for s in range(6))
    assert chi < 60  # 25 degrees of freedom


def test_query_matches_plain_python(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op1_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    for r in out:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_chunk_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(2)
    signs = "ab'sStdlre vm\n\t .,1é  日\u0085!-_\u3000"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|> a", "it's we'll 'S 12 34,5", "日本語 テキスト。", ""]
    encode = ChunkEncoder(*tokenizer_files())
    for part in text_slices(pa.array(texts), 5000):
        ids, begin = encode(part.data, part.bounds)
        for i in range(part.hi - part.lo):
            want = tokenizer.encode(texts[part.lo + i], add_special_tokens=False).ids
            assert ids[begin[i]:begin[i + 1]].tolist() == want


def test_closest_fill_is_closest():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 60)
        got = closest_fill(counts, room)
        assert all(0 < n <= counts[k] for k, n in got.items())
        ways = itertools.product(*[range(n + 1) for n in counts.values()])
        best = max(s for w in ways if (s := sum(a * k for a, k in zip(w, counts, strict=True))) <= room)
        assert sum(k * n for k, n in got.items()) == best


def test_plan_uses_every_piece_once():
    rng = random.Random(6)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(40)}
    used, filled = Counter(), Counter()
    for length, a, b, each, base, shift in fill_plan(counts, 64):
        assert a == used[length]
        used[length] = b
        for s in range((b - a) // each):
            assert filled[base + s] == shift
            filled[base + s] += each * length
    assert used == Counter(counts) and max(filled.values()) <= 64


def _check_packing(rows, texts, tokenizer):
    want = {}
    for name, text in texts:
        want.setdefault(name, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    total, places = 0, defaultdict(list)
    for r in rows:
        assert any(len(ids) == r["doc_tokens"] and zlib.crc32(np.array(
            ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            for ids in want[r["doc_id"]])
        total += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert total == sum(len(i) for v in want.values() for i in v)
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    return total / (1024 * len(places))


def test_packing_given_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op10_packing"](spark, SF).collect()
    assert _check_packing(rows, [(r["doc_id"], r["text"]) for r in docs], tokenizer) > 0.95


def test_packing_messy(spark, messy, tokenizer):
    packed = pack_documents(messy, with_ids=True)
    _check_packing(packed.drop("ids").collect(), [(r["doc_id"], r["text"]) for r in messy.collect()], tokenizer)
    for r in token_sequences(packed).collect():
        assert len(r["ids"]) == 4 * r["length"]
    assert pack_documents(messy.limit(0)).count() == 0
