from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendspark.llm.centroids import cluster_vectors, exact_dots
from spendspark.llm.eigen import empty, merged, rank_one, secular_roots, with_rows
from spendspark.llm.length_packing import WordEncoder, best_fit, pack_by_length
from spendspark.llm.queries import QUERIES
from spendspark.llm.textarrays import text_slices
from spendspark.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string, x int, n int")


def plain_clusters(rows, width, scale, k, rounds, seed=1):
    """The contract of the clustering in plain Python whole numbers."""
    kept = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in rows
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    name = {None: ""}
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{name.get(r[0], r[0])}".encode()).hexdigest(), r[1]))
    here = [list(x) for _, x in order[:k]]
    for number in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(here))
               for _, x in kept]
        if number < rounds:
            for j in range(len(here)):
                mine = [x for (_, x), (_, c) in zip(kept, own, strict=True) if c == j]
                if mine:
                    here[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    by = Counter()
    for d, c in own:
        by[c] += d
    return sorted((-1 if i is None else i, c, d, by[c], sum(by.values()),
                   hashlib.sha256(",".join(map(str, here[c])).encode()).hexdigest())
                  for (i, _), (d, c) in zip(kept, own, strict=True))


def found_clusters(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"],
                   r["inertia"], r["centroid_sha256"]) for r in df.collect())


def odd_vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, spread), 2) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]                    # copies: a third of all
    rows += [rows[1], rows[1], (None, rows[2][1]), (None, None), (900, None), (901, [0.5] * (width - 1)),
             (902, []), (903, [None] + [0.1] * (width - 1)), (904, [math.nan] * width),
             (905, [math.inf] + [0.0] * (width - 1)), (906, [-0.0] * width), (907, [0.0] * width)]
    return rows


@pytest.mark.parametrize(("width", "scale", "k", "rounds", "seed"),
                         [(64, 64, 16, 3, 1), (3, 4, 5, 6, 2), (2, 1, 30, 4, 3), (5, 100_000, 4, 3, 4)])
def test_clusters_against_plain_whole_numbers(spark, width, scale, k, rounds, seed):
    rows = odd_vectors(60, width, seed)
    df = vectors(spark, [(i, v, "clash", 1, 2) for i, v in rows]).repartition(7)
    out = cluster_vectors(df, width=width, scale=scale, centroids=k, rounds=rounds, seed=seed)
    assert out.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found_clusters(out) == plain_clusters(rows, width, scale, k, rounds, seed)


def test_clusters_keep_the_products(spark):
    rows = odd_vectors(20, 4, 9)
    out = cluster_vectors(vectors(spark, [(i, v, "", 0, 0) for i, v in rows]), width=4, scale=8, centroids=3)
    x = {i: [math.floor(8 * c) for c in v] for i, v in rows if i is not None and i < 20}
    for r in out.collect():
        if r["vec_id"] in x:
            norm = sum(c * c for c in x[r["vec_id"]])
            # distance = norm - 2 product + norm of the centroid, the same of all its members
            assert (r["distance"] - norm + 2 * r["dots"][r["cluster"]]) >= 0


def test_clusters_of_few_none_and_large_vectors(spark):
    none = vectors(spark, [(1, None, "", 0, 0), (2, [1.0], "", 0, 0)])
    assert cluster_vectors(none).collect() == [] and cluster_vectors(none.limit(0)).collect() == []
    two = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])]
    df = vectors(spark, [(i, v, "", 0, 0) for i, v in two])
    assert found_clusters(cluster_vectors(df, width=2)) == plain_clusters(two, 2, 64, 16, 3)
    far = [(i, [float(i * 1_000_003), -float(i)]) for i in range(-1, 9)]
    assert found_clusters(cluster_vectors(
        vectors(spark, [(i, v, "", 0, 0) for i, v in far]), width=2, scale=8, centroids=3)) == plain_clusters(
            far, 2, 8, 3, 3)
    with pytest.raises(Exception, match="exceeds"):
        cluster_vectors(vectors(spark, [(1, [1e300, 0.0], "", 0, 0)]), width=2)


def test_exact_dots():
    rng = np.random.default_rng(0)
    for top in (9, 1 << 26):
        a, b = rng.integers(-top, top, (30, 5)), rng.integers(-top, top, (4, 5))
        assert exact_dots(a, b).tolist() == [
            [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


def test_registered_clusters(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found_clusters(QUERIES["op11_centroid_clustering"](spark, SF)) == plain_clusters(rows, 64, 64, 16, 3)


def scatter(x):
    return (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))


def close(s, x):
    v = scatter(x)
    top = max(np.abs(v).max(), 1e-300)
    assert np.abs((s.vectors * s.values) @ s.vectors.T - v).max() <= 1e-12 * top
    assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs(s.values - np.linalg.eigvalsh(v)).max() <= 1e-12 * top
    assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0), rtol=1e-12, atol=1e-12)


def eigen_cases():
    rng = np.random.default_rng(5)
    yield rng.integers(-99, 99, (300, 12)).astype(float)
    yield np.repeat(rng.integers(-9, 9, (3, 7)), 30, axis=0).astype(float)          # few distinct ones
    yield np.eye(9)[rng.integers(0, 9, 200)] * 256                                   # equal poles
    yield np.floor(rng.normal(size=(100, 2)) @ rng.normal(size=(2, 8)) * 9)
    yield np.floor(rng.normal(size=(200, 10)) * np.logspace(0, 6, 10))               # wide spectrum
    yield np.full((5, 4), 3.0)
    yield rng.integers(-3, 3, (40, 1)).astype(float)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_spectra_follow_the_scatter(block):
    for x in eigen_cases():
        s = empty(x.shape[1])
        for at in range(0, len(x), block):
            s = with_rows(s, x[at:at + block])
        close(s, x)
        cut = len(x) // 3
        one, two = with_rows(empty(x.shape[1]), x[:cut]), with_rows(empty(x.shape[1]), x[cut:])
        close(merged(one, two), x)
        assert merged(one, empty(x.shape[1])) is one and merged(empty(x.shape[1]), one) is one


def test_secular_roots_and_deflation():
    d, w = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1.0, 1e-8, 2.0, 3.0])
    near, x = secular_roots(d, w)
    roots = d[near] + x
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(w, w))), rtol=1e-13)
    assert (roots[:-1] <= d[1:]).all() and (roots >= d).all()
    values, vectors = rank_one(np.array([1.0, 2.0, 3.0]), np.eye(3), np.array([0.0, 2.0, 0.0]))
    assert sorted(values) == [1.0, 3.0, 6.0] and np.abs(vectors).max(axis=0).tolist() == [1, 1, 1]


def plain_whitening(rows, scale, k):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    width = max(Counter(len(v) for _, v in kept).items(), key=lambda t: (t[1], t[0]))[0]
    kept = [(i, v) for i, v in kept if len(v) == width]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float)
    values, own = np.linalg.eigh(scatter(x) / n)
    return kept, n, sums, values[::-1][:k], own[:, ::-1][:, :k], values.sum(), np.array(sums) / n


@pytest.mark.parametrize(("width", "block", "group"), [(6, 1, 2), (64, 16, 3), (3, 1024, 16)])
def test_whitening_against_numpy(spark, width, block, group):
    rows = odd_vectors(90, width, width, 2.0)
    df = vectors(spark, [(i, v, "clash", 1, 2) for i, v in rows]).repartition(9)
    out = whiten(df, block_rows=block, group=group).collect()
    kept, n, sums, values, own, trace, mean = plain_whitening(rows, 256, 4)
    k = min(4, width)
    assert len(out) == len(kept) * k and {r["component"] for r in out} == set(range(1, k + 1))
    by = defaultdict(list)
    for r in out:
        by[r["vec_id"]].append(r)
    sign = [0] * k
    for i, x in kept:
        for r in by[i]:
            c = r["component"] - 1
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            want = (np.array(x) - mean) @ own[:, c] / math.sqrt(values[c])
            sign[c] = sign[c] or (1 if want * r["whitened"] > 0 else -1)
            assert r["whitened"] == pytest.approx(sign[c] * want, rel=1e-9, abs=1e-9)
            assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


def test_whitening_without_variance_or_rows(spark):
    def run(rows):
        return whiten(vectors(spark, [(i, v, "", 0, 0) for i, v in rows])).collect()

    assert run([]) == [] and run([(1, None), (2, []), (3, [math.nan])]) == []
    same = run([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert len(same) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"])
                               for r in same} == {(1, 0, None, None, None)}
    line = run([(i, [float(i), 0.0, 2.0 * i]) for i in range(9)])
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True, 3: True}
    mixed = run([(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 5.0])])
    assert {r["vec_id"] for r in mixed} == {2, 3}


def test_registered_whitening(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    kept, n, sums, values, own, trace, mean = plain_whitening(rows, 256, 4)
    out = QUERIES["op12_embedding_whitening"](spark, SF).toPandas()
    white = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    want = (np.array([v for _, v in sorted(kept)]) - mean) @ own / np.sqrt(values)
    assert np.abs(np.abs(white) - np.abs(want)).max() < 1e-9
    assert np.allclose(out.groupby("component").explained.first(), values / trace, rtol=1e-10)
    assert out.identity_error.max() < 1e-10 and len(out) == 4 * len(kept)


ODD_TEXTS = [
    "", " ", "don't DON'T ain't we'll you're I'm she'd they've 's", "a!'s b'S c 'tis", "x1y22z",
    "café café CAFÉ!́ a ́b", "İstanbul STRASSE ẞ ΣΣ", "a  b \tc\r\n\n d",
    "你好，世界 สวัสดี \U0001f600\U0001f680!", "end<|endoftext|>more <|startoftext|> <|END", "क्ष ‍‌ a‍b",
    "a×b÷c İx xİ ŉ ǰ ȿ ɀ é×", "".join(chr(c) + "x " for c in range(0xC0, 0x250)), "H̱ẖ W̊ T̈x J̌ KẘA", "word" * 900, "9" * 50 + "a" * 50, "'" * 40 + "s't", "Å Ω ﬁ ͅx", "tab\tx\x0by\x0cz\x1cq\x85w",
]


def test_word_encoder_gives_the_tokenizers_ids():
    rng = random.Random(8)
    signs = list("abz AZ09'!s t.\n\t-") + ["é", "́", " ", "你", "\U0001f600", "'re", " '", "Σ", " "]
    texts = [t for t in ODD_TEXTS if "<|" not in t] + [
        "".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    plain, encode = Tokenizer.from_file(WORDS), WordEncoder(WORDS)
    for group in (texts, ODD_TEXTS):
        want = [e.ids for e in plain.encode_batch(group, add_special_tokens=False)]
        for limit in (1 << 20, 200):
            got = []
            for part in text_slices(pa.array(group), limit):
                ids, begin = encode(part.data, part.bounds)
                got += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            assert got == want


def piece_by_piece(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - length)
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 200])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 9, 60]) for _ in range(rng.randint(0, 40))}
    plan = best_fit(counts, capacity)
    filled, seen = defaultdict(list), Counter()
    for length, lo, hi, each, base, shift in plan:
        assert lo == seen[length]
        seen[length] = hi
        for rank in range(lo, hi):
            at = rank - lo
            filled[base + at // each].append((shift + at % each * length, length))
    assert dict(seen) == counts
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    assert sorted(filled) == list(range(len(filled)))
    assert sorted(capacity - sum(n for _, n in p) for p in filled.values()) == piece_by_piece(counts, capacity)


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(1)
    counts = {k: rng.randint(1, 50) for k in range(1, 4096)}
    small, large = best_fit(counts, 4096), best_fit({k: n * 10 ** 7 for k, n in counts.items()}, 4096)
    assert len(large) < 4 * 4096 and len(small) < 4 * 4096


def check_packing(rows, texts, capacity):
    """Every id of every document in one piece, sequences gapless; gives the number of sequences."""
    plain = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, text in texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want[(i, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(n for _, n in parts) <= capacity
    assert len(sequences) == len(piece_by_piece(Counter(r["length"] for r in rows), capacity))
    return len(sequences)


def test_packs_whole_documents(spark, messy):
    texts = [(r["doc_id"], r["text"]) for r in messy.collect()] + list(enumerate(ODD_TEXTS, 500))
    texts += [(7, None)] * 40 + [(None, "again")] * 3
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in texts],
                               "doc_id long, text string, length int, place string, rank int").repartition(5)
    for capacity, group_rows in ((16, 3), (64, 1000)):
        check_packing(pack_by_length(df, capacity=capacity, group_rows=group_rows).collect(), texts, capacity)
    assert pack_by_length(df.limit(0)).collect() == []


def test_registered_packing(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = QUERIES["op13_best_fit_packing"](spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    used = check_packing(out.collect(), texts, 4096)
    assert used <= math.ceil(out.agg(F.sum("length")).first()[0] / 4096) * 1.03 + 1
