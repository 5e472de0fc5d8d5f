from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from spendspark.functions.similarity import indel_distance, token_set_score
from spendspark.operators import merchants
from spendspark.operators.merchants import canonical_names, name_keys, ranked_names


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def score(a, b):
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    i, da, db = wa & wb, wa - wb, wb - wa
    if i and (not da or not db):
        return 100.0
    ji, ja, jb = (" ".join(sorted(s)) for s in (i, da, db))
    gap = 1 if i else 0
    total = 2 * (len(ji) + gap) + len(ja) + len(jb)
    best = 100 - 100 * indel(ja, jb) / total
    if i:
        for d in (ja, jb):
            best = max(best, 100 - 100 * (1 + len(d)) / (2 * len(ji) + 1 + len(d)))
    return best


def greedy(names, threshold=88):
    order = [n for n, _ in sorted(names, key=lambda x: (-x[1], x[0]))]
    out = {}
    for n in order:
        if n in out:
            continue
        for m in order:
            if m not in out and (m == n or score(n, m) >= threshold):
                out[m] = n
    return out


def random_names(seed, n):
    rng = random.Random(seed)
    words = ["CHAI", "POINT", "CHAIPOINT", "STORE", "STORES", "MART", "A", "B", "ABC", "RELIANCE",
             "FRESH", "SMART", "ELECTRONICS", "ÉPICERIE"]

    def word():
        w = rng.choice(words)
        if rng.random() < 0.4:
            i = rng.randint(0, len(w))
            w = w[:i] + rng.choice(["", "X", "Q", "ZZ"]) + w[i + rng.randint(0, 1):]
        return w or "W"

    return [(s, rng.randint(1, 6)) for s in {" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(n)}]


def test_score_goldens(spark):
    cases = [
        ("CHAI POINT", "CHAIPOINT", 100 - 100 * 1 / 19), ("A B", "B A", 100.0), ("A", "A STORE", 100.0),
        ("", "A", 0.0), ("SMALL RIN", "SMALL RING", 100 - 100 * 1 / 19), ("ABC", "XYZ", 0.0),
        ("RELIANCE RETAIL X", "RELIANCE RETAIL Y", 100 - 100 * 2 / 34), ("SAME SAME", "SAME", 100.0),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r["score"] for r in token_set_score(df, "a", "b").orderBy("i").collect()]
    assert got == pytest.approx([c[2] for c in cases])


def test_score_random_and_cutoff(spark):
    names = [n for n, _ in random_names(1, 60)]
    pairs = [(a, b) for a in names for b in names if a < b]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r["a"], r["b"]): r["score"] for r in token_set_score(df, "a", "b").collect()}
    assert got == pytest.approx({p: score(*p) for p in pairs})
    cut = {(r["a"], r["b"]) for r in token_set_score(df, "a", "b", 88.0).filter("score >= 88").collect()}
    assert cut == {p for p in pairs if score(*p) >= 88}


def test_edit_distance_of_any_length(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé😀 c") for _ in range(n)) for n in (0, 1, 2, 30, 61, 62, 63, 64, 124, 125, 190)]
    pairs = [(x, y) for x in texts for y in texts] + [("a" * 130, "a" * 200), ("ab" * 70, "ba" * 70)]
    df = spark.createDataFrame(pairs, "x string, y string").withColumn("d", indel_distance(F.col("x"), F.col("y")))
    assert {(r["x"], r["y"]): r["d"] for r in df.collect()} == {p: indel(*p) for p in pairs}


@pytest.mark.parametrize("threshold", [70, 88, 95])
def test_keys_lose_no_pair(spark, threshold):
    names = random_names(2, 400)
    keyed = name_keys(ranked_names(spark.createDataFrame(names, "name string, n long")), threshold).collect()
    lkeys = {r["name"]: set(r["lkeys"]) for r in keyed}
    rkeys = {r["name"]: set(r["rkeys"]) for r in keyed}
    all_names = sorted(lkeys)
    similar = [(a, b) for a in all_names for b in all_names if a != b and score(a, b) >= threshold]
    assert similar and all(lkeys[a] & rkeys[b] for a, b in similar)


@pytest.mark.parametrize("n, batch_rows, pair_budget", [(160, 20_000, 10**9), (160, 40, 10**9), (40, 40, 1000)])
def test_canonical_names_equal_greedy(spark, n, batch_rows, pair_budget):
    names = random_names(3, n)
    df = spark.createDataFrame(names, "name string, n long")
    got = canonical_names(df, 88, batch_rows=batch_rows, pair_budget=pair_budget).collect()
    assert {r["name"]: r["canonical"] for r in got} == greedy(names)
    assert all(r["score"] == pytest.approx(score(r["name"], r["canonical"])) for r in got)


def test_crowded_keys_are_dealt_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(merchants, "LEFT_PIECE", 3)
    monkeypatch.setattr(merchants, "RIGHT_PIECE", 5)
    names = random_names(4, 120)
    df = spark.createDataFrame(names, "name string, n long")
    got = canonical_names(df, 88, batch_rows=40).collect()
    assert {r["name"]: r["canonical"] for r in got} == greedy(names)
    ranked = merchants.durable(name_keys(ranked_names(df), 88))
    pairs = merchants.similar_pairs(ranked, ranked, 88)
    plan = pairs._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan


def test_crowd_of_near_copies(spark):
    names = [(f"RELIANCE FRESH {i:04d}", 1) for i in range(300)] + [("RELIANCE FRESH", 500)]
    got = canonical_names(spark.createDataFrame(names, "name string, n long"), pair_budget=2000).collect()
    assert {r["canonical"] for r in got} == {"RELIANCE FRESH"} and len(got) == 301


def test_no_names(spark):
    assert canonical_names(spark.createDataFrame([], "name string, n long")).count() == 0
    with pytest.raises(ValueError):
        canonical_names(spark.createDataFrame([("A", 1)], "name string, n long"), 50)


@pytest.mark.parametrize("at_once", [50_000, 7])
def test_chains_of_names_take_few_steps(spark, monkeypatch, at_once):
    rng = random.Random(11)
    chain = [(i, i + 1) for i in range(60)]
    edges = chain + [(a, b) for a in range(60) for b in range(a + 2, 60) if rng.random() < 0.02]
    taken = set()
    for a, b in sorted(edges, key=lambda e: e[1]):
        if a not in taken:
            taken.add(b)
    stored = []
    monkeypatch.setattr(merchants, "LOCAL_PAIRS", at_once)
    monkeypatch.setattr(merchants, "durable", lambda df, keep=merchants.durable: stored.append(1) or keep(df))
    members = merchants.batch_members(spark.createDataFrame(edges, "l_rank bigint, r_rank bigint"))
    assert sorted(r[0] for r in members.collect()) == sorted(taken)
    assert len(stored) <= 3 * -(-len(edges) // at_once)
    assert merchants.batch_members(spark.createDataFrame([], "l_rank bigint, r_rank bigint")) is None


def test_many_steps_make_no_plan_longer(spark, monkeypatch):
    """However many steps and batches settle names, what comes back reads one table of them."""
    edges = [(a, a + d) for a in range(0, 400, 4) for d in (1, 2, 3)]
    monkeypatch.setattr(merchants, "LOCAL_PAIRS", 30)
    members = merchants.batch_members(spark.createDataFrame(edges, "l_rank bigint, r_rank bigint"))
    assert sorted(r[0] for r in members.collect()) == sorted({b for _, b in edges})
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(members) == 1
    names = random_names(6, 60)
    got = canonical_names(spark.createDataFrame(names, "name string, n long"), 88, batch_rows=10)
    assert {r["name"]: r["canonical"] for r in got.collect()} == greedy(names)
    assert scans(got) == 3
