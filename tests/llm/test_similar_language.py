from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendspark.llm import line_dedup
from spendspark.llm.components import connected
from spendspark.llm.language import (
    Field, Settings, detect_languages, fit_field, learn_languages, posteriors)
from spendspark.llm.line_dedup import (
    block_keys, drop_repeated_lines, edit_room, line_rows, line_texts, majority)
from spendspark.llm.minhash import shingle_sets, signatures, weights
from spendspark.llm.near_duplicates import keep_one_of_each, near_duplicate_classes
from spendspark.llm.queries import QUERIES
from spendspark.llm.textarrays import text_slices

SF = "/root/testdata/sf0.001"
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_connected(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 501)]
    links += [(rng.randint(600, 660), rng.randint(600, 660)) for _ in range(40)]
    got = connected(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in got} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = ITEM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(rng):
    rows, base = [], [[f"w{rng.randint(0, 5000)}" for _ in range(120)] for _ in range(6)]
    for i in range(90):
        own = list(base[i % 6])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 9999)}"
        rows.append((1000 + i, " ".join(own)))
    return rows + [(200, "Two words"), (201, "two, words!"), (202, "two words more"), (203, rows[0][1]), (-5, rows[1][1].upper())]


@pytest.mark.parametrize("tile", [512, 4])
def test_near_duplicates_against_all_pairs(spark, make_docs, messy, tile):
    rows = near_copies(random.Random(3)) + [(r["doc_id"], r["text"]) for r in messy.collect()]
    docs = make_docs(rows)
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    top = roots(range(len(rows)), links)
    want = []
    for i, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in top if top[j] == top[i] and rows[j][0] is not None] if sets[i] else [name]
        want.append((name, min(ids) if ids else None))
    got = near_duplicate_classes(docs, tile=tile).select("doc_id", "class_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    if tile == 512:
        kept = keep_one_of_each(docs)
        assert kept.columns == docs.columns
        names = [r["doc_id"] for r in kept.select("doc_id").collect()]
        alone = [n for n, s in zip((r[0] for r in rows), sets, strict=True) if not s]
        assert sorted(map(repr, names)) == sorted(map(repr, [*{c for (_, c), s in zip(want, sets, strict=True) if s}, *alone]))
        assert near_duplicate_classes(docs.limit(0)).count() == 0 and keep_one_of_each(docs.limit(0)).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(1)
    a = [f"a{i}" for i in range(300)]
    b = a[:240] + [f"b{i}" for i in range(60)]
    rng.shuffle(a)
    texts = pa.array([" ".join(a), " ".join(b), " ".join(a), ""])
    part = next(text_slices(texts))
    owner, values, counts = shingle_sets(part, 1)
    weight = weights(counts) * np.where(values % np.uint64(2), 3.0, 1.0)
    sig = signatures(owner, values, weight, 4, 2048)
    assert (sig[0] == sig[2]).all() and (sig[3] == 0).all()
    w = [dict(zip(values[owner == t].tolist(), weight[owner == t], strict=True)) for t in (0, 1)]
    exact = sum(1 / sum(max(w[0].get(j, 0) / w[0][i], w[1].get(j, 0) / w[1][i]) for j in {*w[0], *w[1]})
                for i in set(w[0]) & set(w[1]))
    assert abs((sig[0] == sig[1]).mean() - exact) < 5 * (exact * (1 - exact) / 2048) ** 0.5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_lines(rows, copies=None):
    """Texts without repeated lines, by edit similarity of all pairs of different lines.

    ``rows`` are (doc_id, text, hash of the text); gives (doc_id, text, numbers of removed lines).
    """
    texts = {}
    for name, text, th in rows:
        for no, line in enumerate([] if text is None else text.split("\n")):
            norm = re.sub(r"[\W_]+", " ", line.lower()).strip()
            if len(norm) >= 4:
                texts[(name is not None, name or 0, th, no)] = norm
    distinct = sorted(set(texts.values()))
    links = [(a, b) for a, b in itertools.combinations(distinct, 2)
             if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) * 10 <= max(len(a), len(b))
             and edits(a, b) * 10 <= max(len(a), len(b))]
    top, first = roots(distinct, links), {}
    for at in sorted(texts):
        first.setdefault(top[texts[at]], at)
    gone = {at for at, norm in texts.items() if first[top[norm]] != at}
    if copies is not None:
        stay, held = Counter(), defaultdict(Counter)
        for at, norm in texts.items():
            lead = first[top[norm]]
            if at not in gone:
                stay[at[:3]] += len(norm)
            elif lead[:3] != at[:3]:
                held[at[:3]][lead[:3]] += 0
                held[at[:3], lead[:3]]["all"] += len(norm)
                held[at[:3], lead[:3]]["equal"] += len(norm) * (texts[lead] == norm)
        for doc in [d for d in held if len(d) == 3]:
            _, source = max(((held[doc, src]["equal"], held[doc, src]["all"]), src) for src in held[doc])
            equal, all_ = held[doc, source]["equal"], held[doc, source]["all"]
            if equal >= copies * (stay[doc] + all_) and equal >= copies * stay[source]:
                gone -= {at for at in gone if at[:3] == doc and first[top[texts[at]]][:3] == source}
    out = []
    for name, text, th in rows:
        no = [i for i in range(0 if text is None else text.count("\n") + 1)
              if (name is not None, name or 0, th, i) in gone]
        out.append((name, text if text is None else "\n".join(
            x for i, x in enumerate(text.split("\n")) if i not in no), no))
    return sorted(out, key=repr)


def line_documents(rng):
    base = [" ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.randint(0, 99)}" for _ in range(14)) for _ in range(8)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(base).split()
            if rng.random() < 0.6:
                w[rng.randrange(14)] += rng.choice("xyz")
            lines.append(rng.choice([" ".join(w), " ".join(w).upper() + "!!", "short line", ""]))
        rows.append((i % 50, "\n".join(lines)))
    return rows


def hashed_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]


def test_lines_of_repeated_words(make_docs):
    rows = [(i, " ".join(["tic tac"] * 40 + [w])) for i, w in enumerate(["one", "two", "three"])]
    rows.append((9, "\n".join([" ".join(["tic"] * 70), " ".join(f"n{i}" for i in range(70))])))
    out = drop_repeated_lines(make_docs(rows)).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in out} == {0: [], 1: [0], 2: [0], 9: []}


@pytest.mark.parametrize("limits", [{}, {"HOT": 2, "SAMPLE": 1}, {"HOT": 1, "SAMPLE": 1, "HOT_KEYS": 7}, {"OFTEN": 1}])
def test_lines_against_all_pairs(make_docs, messy, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(f"spendspark.llm.line_dedup.{name}", value)
    docs = make_docs(line_documents(random.Random(5))).unionByName(messy).repartition(6)
    out = drop_repeated_lines(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    want = plain_lines(hashed_rows(docs))
    assert sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in out.collect()), key=repr) == want
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_pairs_in_a_crowded_block(make_docs, monkeypatch):
    """Lines that share one block only, the one that very many other lines share too."""
    monkeypatch.setattr("spendspark.llm.line_dedup.PIECE", 16)
    rng = random.Random(3)
    line = lambda: ["please", "note", "that", *["".join(rng.choices("abcdefgh", k=5)) for _ in range(25)]]
    rows = [(i, " ".join(line())) for i in range(60)]
    for i in range(5):
        near = rows[10 * i][1].split(" ")
        for at in range(4, 28, 3):  # a letter in each of the other blocks, from either end
            near[at] = "z" + near[at][1:]
        for at in range(27 - 1, 12, -3):
            near[at] = "z" + near[at][1:]
        rows.append((100 + i, " ".join(near)))
    out = drop_repeated_lines(make_docs(rows)).collect()
    assert {r["doc_id"] for r in out if r["removed_lines"]} == {100 + i for i in range(5)}


def test_unlike_lines_of_a_crowded_block_form_no_pairs(spark, make_docs, monkeypatch):
    """Lines of one block whose letters are too far apart are no pairs for the disk, similar ones
    stay, and pairs are compared in parts."""
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    sets = ["aeiouts", "bcdfghj", "klmnpqr", "vwxyzst", "rstlnea"]
    rows = [(i, " ".join(["please", "note", "that", *[word(sets[i % 5]) for _ in range(17)]])) for i in range(60)]
    rows += [(100 + i, rows[i][1][:-1] + "q") for i in range(5)]
    tables = []

    def noted(df, name):
        table = stored(df, name)
        tables.append((name, table.count()))
        return table

    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", noted)
    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 100)
    out = drop_repeated_lines(make_docs(rows)).collect()
    assert {r["doc_id"] for r in out if r["removed_lines"]} == {100 + i for i in range(5)}
    pairs = [n for name, n in tables if name == "line-pairs"]
    assert len(pairs) == 2 and sum(pairs) < 400  # of 2,080
    assert len([n for name, n in tables if name == "line-links"]) > 2


@pytest.mark.parametrize("similar", [0.9, 0.8])
def test_letters_never_part_similar_lines(spark, similar):
    """Differences of letters are a lower bound of the edits, in long lines and beyond the most that is counted."""
    rng = random.Random(8)
    rows = []
    for n in [20, 30, 60, 200, 900, 3000]:
        for i in range(12):
            x = [rng.choice("etaoin srhldé9zx"[: 2 + i] if i % 2 else "etaoinsrhldé9zxö ") for _ in range(n)]
            y = list(x)
            for _ in range(int(n * (1 - similar))):
                y[rng.randrange(len(y))] = rng.choice(["", "e", "t", "q ", "zz", "é"])
            for line in (x, y):
                rows.append((len(rows), "a" + "".join(line) + "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines, groups = line_dedup.line_tables(docs, 1)
    counts = line_dedup.letter_counts(lines, groups, lines)
    a, b = (lines.where(F.col("doc_id") % 2 == i).select(
        F.floor(F.col("doc_id") / 2).alias("i"), F.col("sid").alias(c), F.col("norm").alias(f"{c}_norm")) for i, c in enumerate("ab"))
    room = line_dedup.edit_room(F.greatest(F.length("a_norm"), F.length("b_norm")), similar)
    pairs = a.join(b, "i").where("a <> b").where(F.levenshtein("a_norm", "b_norm") <= room)
    both = pairs.join(line_dedup._letters(counts, "a"), "a").join(line_dedup._letters(counts, "b"), "b")
    assert both.count() > 30 and both.where(~line_dedup._near_in_letters("a", "b", similar)).count() == 0


def test_copies_keep_their_lines(make_docs):
    rng = random.Random(9)
    line = lambda: " ".join(f"q{rng.randint(0, 10 ** 6)}" for _ in range(12))
    own, footer = [line() for _ in range(12)], line()
    near = [*own[:11], own[11] + " and more"]
    rows = [(1, footer), (2, "\n".join([*own, footer])), (3, "\n".join([*own, footer])), (4, "\n".join(near)),
            (5, "\n".join([*own[:6], *[line() for _ in range(6)]])), (6, "\n".join(own[:3])), (7, None), (8, ""),
            (9, "\n".join([footer, footer])), (None, line())]
    docs = make_docs(rows)
    out = drop_repeated_lines(docs, copies=0.9).collect()
    assert sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in out), key=repr) == plain_lines(
        hashed_rows(docs), 0.9)
    gone = {r["doc_id"]: r["removed_lines"] for r in out}
    # copies lose what their original lost; a part of it loses all its lines
    assert gone[2] == gone[3] == [12] and gone[4] == [] and gone[5] == list(range(6)) and gone[6] == [0, 1, 2]


def keys_of(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    rows = line_texts(line_rows(df), 1).select("doc_id", "sid", "norm")
    out = {i: set() for i in range(len(lines))}
    for r in block_keys(rows).join(rows, "sid").collect():
        out[r["doc_id"]].add(r["key"])
    return [out[i] for i in range(len(lines))]


def test_edits_move_the_blocks_of_their_stretch(spark):
    a, b, c = 0b1100, 0b1010, 0b0111
    assert spark.range(1).select(majority(F.lit(a), F.lit(b), F.lit(c))).first()[0] == 0b1110
    rng = random.Random(2)
    words = [f"word{rng.randint(1000, 9999)}" for _ in range(24)]
    long = [f"word{rng.randint(0, 9999)}" for _ in range(60)]
    changed = lambda w, *at: " ".join(x + "x" if i in at else x for i, x in enumerate(w))
    cells = "aqzwsxedcrfvtgbyhnujmikolp0987654321abcdefgh"
    got = keys_of(spark, [
        changed(words), changed(words, 9), changed(words, 9, 21), " ".join(["new", *words]), " ".join([*words, "new"]),
        changed(long), changed(long, 7, 8), cells, cells[:8] + "-" + cells[9:], "x" + cells,
        changed(words[::-1]), "".join(chr(0x4E00 + i * 7) for i in range(300))])
    apart = [len(got[0] - x) for x in got]
    assert len(got[0]) == 8 and apart[1:3] == [1, 2]
    # a word put in moves the blocks of its half only
    assert apart[3] == apart[4] == 4
    assert len(got[5]) == 20 and len(got[5] - got[6]) == 1
    assert len(got[7]) == 8 and len(got[7] - got[8]) == 1 and len(got[7] - got[9]) == 4
    assert not got[0] & got[10] and len(got[11]) == 26


def test_lines_alone_in_their_blocks_are_not_kept(spark, make_docs, monkeypatch):
    """Keys that one line has are read once and never stored; hot keys give the same blocks."""
    rng = random.Random(9)
    lines = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(12)) for _ in range(40)]
    lines += [f"{lines[0]} {c}" for c in "abcdef"]
    docs = make_docs(enumerate(lines))
    rows = []

    def counted(df, name):
        table = stored(df, name)
        rows.append((name, table.count()))
        return table

    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", counted)
    assert drop_repeated_lines(docs).where("size(removed_lines) > 0").count() == 6
    rows = dict(reversed(rows))
    assert "line-keys" not in rows and 0 < rows["line-blocks"] <= 7 * 12
    keys = block_keys(line_texts(line_rows(docs), 1).select("sid", "norm"))
    hot = keys.groupBy("key").count().where("count > 2").select("key")
    blocks = [sorted(map(tuple, line_dedup.line_blocks(keys, h).collect())) for h in (None, hot)]
    assert blocks[0] == blocks[1] and len(blocks[0]) == rows["line-blocks"]
    sizes = {k: n for k, n in keys.groupBy("key").count().collect()}
    assert all(b[4] <= sizes[b[0]] and b[7] <= sizes[b[0]] and max(b[4], b[7]) > 1 for b in blocks[0])


def test_tables_and_shuffles_go_when_nothing_reads_them(spark, make_docs, monkeypatch):
    """Of lines, keys and pairs nothing stays but the answer; a write's shuffles go with it."""
    from pathlib import Path
    from time import sleep

    rng = random.Random(12)
    lines = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(12)) for _ in range(30)]
    lines += [f"{lines[0]} {c}" for c in "abcdef"] + lines[:3]
    kept, late = [], []
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in map(str, files.getAllFiles().mkString("\n").split("\n")) if "/shuffle_" in f}

    def noted(df, name):
        before = shuffles()
        table = stored(df, name)
        for _ in range(30):  # they are deleted a moment later
            if not shuffles() - before:
                break
            sleep(0.1)
        else:
            late.append(name)
        kept.append((name, Path(table.stored_path.removeprefix("file:"))))
        return table

    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", noted)
    assert drop_repeated_lines(make_docs(enumerate(lines))).where("size(removed_lines) > 0").count() == 9
    assert late == []
    left = {name for name, path in kept if path.exists()}
    assert len(kept) > 10 and left <= {"line-links", "line-removed"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_line_recall_over_spread_edits(spark, make_docs):
    """Lines with letters changed all over, found by plain edit similarity: 95 % or more of them."""
    rng = random.Random(4)
    rows = line_texts(line_rows(spark.read.parquet(f"{SF}/documents.parquet")), 20)
    lines = sorted(r["norm"] for r in rows.select("norm").distinct().collect() if len(r["norm"]) < 1000)
    pairs = []
    for line in rng.sample(lines, 600):
        other, room = list(line), len(line) // 10
        at = [i for i, x in enumerate(other) if x != " "]
        for i in sorted(rng.sample(at, min(len(at), max(1, int(len(line) * rng.uniform(0.03, 0.09))))), reverse=True):
            other[i:i + 1] = [rng.choice("abcdefghijklmnop"), "", other[i] + rng.choice("aeiou")][rng.choice([0, 0, 1, 2])]
        text = " ".join("".join(other).split())
        if text != line and abs(len(text) - len(line)) <= room:
            pairs.append((line, text))
    near = spark.createDataFrame(pairs, "a string, b string").where(
        "levenshtein(a, b) * 10 <= greatest(length(a), length(b))").collect()
    docs = make_docs([(2 * i + j, x) for i, r in enumerate(near) for j, x in enumerate(r)])
    gone = {r["doc_id"] for r in drop_repeated_lines(docs).where("size(removed_lines) > 0").collect()}
    assert len(near) > 500 and len({d // 2 for d in gone}) >= 0.95 * len(near)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    scores, first, steps = rng.normal(size=(7, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    bounds = np.array([0, 4, 4, 5, 7])
    got, moves = posteriors(scores, bounds, first, steps)
    want, want_moves = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in itertools.pairwise(bounds):
        paths = list(itertools.product(range(3), repeat=int(b - a))) if b > a else []
        logs = [first[p[0]] + sum(scores[a + i, k] for i, k in enumerate(p))
                + sum(steps[x, y] for x, y in itertools.pairwise(p)) for p in paths]
        chance = np.exp(logs) / np.exp(logs).sum() if paths else []
        for p, c in zip(paths, chance, strict=True):
            for i, k in enumerate(p):
                want[a + i, k] += c
            for x, y in itertools.pairwise(p):
                want_moves[x, y] += c
    assert np.allclose(got, want) and np.allclose(moves, want_moves)


def test_code_switched_text(make_docs):
    rng = random.Random(1)
    en = lambda n: " ".join(rng.choice(["the", "thing", "wherth", "ing", "and"]) for _ in range(n))
    fr = lambda n: " ".join(rng.choice(["le", "eaux", "queoi", "étion", "une"]) for _ in range(n))
    field = fit_field([(en(60), "en") for _ in range(30)] + [(fr(60), "fr") for _ in range(30)], Settings())
    row = detect_languages(make_docs([(1, en(9) + " 12 " + fr(20) + ", " + en(8))]), field).first()
    assert [(r["word"], r["words"], r["lang"]) for r in row["runs"]] == [(0, 9, "en"), (9, 20, "fr"), (29, 8, "en")]
    assert row["lang_pred"] == "fr" and 0.5 < row["score"] < 0.7


def test_held_out_languages(spark):
    given = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op4_language_id"](spark, SF).collect() if r["held_out"]]
    assert len(rows) > 20 and sum(given[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_languages_of_messy_texts(make_docs, messy):
    none = detect_languages(messy, learn_languages(messy.withColumn("lang", F.lit(None).cast("string"))))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    field = learn_languages(messy)
    assert isinstance(field, Field) and field.languages == ["en"]
    rows = detect_languages(messy, field).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 6)} == {"und"}
    assert detect_languages(messy.limit(0), field).count() == 0


def run_stages(spark, docs, sf_dir):
    """What each stage but the last leaves, read again from Parquet."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert sorted(after.columns) == sorted(docs.columns), name
        path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/stage-{name}-{random.getrandbits(60)}"
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        yield name, docs


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for _, docs in run_stages(spark, docs, SF):
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > counts[4] > 0
    assert near_duplicate_classes(docs).where("doc_id <> class_id").count() == 0
    assert docs.where("size(split(trim(text), '\\\\s+')) < 50").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[4]


def planted_documents(rng):
    """Documents of lines, with every case that a stage decides on."""
    line = lambda n=14: " ".join(f"t{rng.randint(0, 10 ** 6)}" for _ in range(n))
    text = lambda n=6: "\n".join(line() for _ in range(n))
    item, footer = line(40), line(20)
    rows = {i: text() for i in range(10)}
    rows[20], rows[21] = rows[3], rows[3]                                       # exact copies
    rows[22] = rows[4].replace("\n", " ")                                       # a copy in one line
    rows[23] = "\n".join([*rows[5].split("\n")[:5], line()])                    # five of six lines elsewhere
    rows[24] = "\n".join(x + "q" for x in rows[6].split("\n"))                  # all lines fuzzy copies
    rows[25] = "\n".join(rows[7].split("\n")[:5])                               # a part
    rows[26] = text() + "\n" + footer
    rows[27] = text() + "\n" + footer[:-1] + "7"
    rows[28] = text(3) + "\n" + item                                           # a benchmark passage
    rows[29], rows[30], rows[31], rows[32] = None, "", " \n\t", "too short"
    rows[33] = "\n".join([line(30)] * 9)                                        # repeats itself
    rows[34] = rows[8] + "\n" + footer                                          # a copy and a footer
    listed = list(rows.items()) + [(9, rows[9]), (9, rows[9]), (None, text()), (None, None)]
    return listed, [("i1", item), ("i2", None), ("i3", line(30)), ("i3", "")]


def test_pipeline_against_plain_python(spark, make_docs, tmp_path):
    rows, items = planted_documents(random.Random(21))
    docs = make_docs(rows).repartition(4)
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {name: sorted(hashed_rows(d), key=repr) for name, d in run_stages(spark, docs, str(tmp_path))}
    ids = {name: [r[0] for r in kept] for name, kept in texts.items()}

    # quality: too few words, or mostly repeats of its own
    words = lambda text: (text or "").split()
    bad = {29, 30, 31, 32, 33}
    assert [r[:2] for r in texts["quality_rules"]] == sorted(
        ((n, t) for n, t in rows if n not in bad and len(words(t)) >= 50), key=repr)
    # lines: by edit similarity of all pairs, copies left alone; what is too short now goes
    want = [(n, t) for n, t, gone in plain_lines(texts["quality_rules"], corpus_pipeline.COPY_SHARE)
            if not gone or len(words(t)) >= 50]
    assert [r[:2] for r in texts["line_dedup"]] == sorted(want, key=repr)
    assert {20, 21, 34} <= set(ids["line_dedup"]) and not {23, 24, 25} & set(ids["line_dedup"])
    # near duplicates: one of each group of shingle sets with a Jaccard similarity of 0.8 or more
    sets = [shingles(t) for _, t, _ in texts["line_dedup"]]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    classes = len(set(roots(range(len(sets)), links).values()))
    assert len(ids["minhash_near_dedup"]) == classes < len(sets)
    assert not {20, 21, 22, 34} & set(ids["minhash_near_dedup"]) and ids["minhash_near_dedup"].count(9) == 1
    # benchmark passages
    assert ids["decontaminate"] == [n for n in ids["minhash_near_dedup"] if n != 28]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path))
    assert packed.count() == 0
    empty = docs.limit(0)
    for _, empty in run_stages(spark, empty, str(tmp_path)):
        assert empty.count() == 0


def fuzzy_pairs(rng):
    """(line, its changed copy) within the similarity: words swapped, letters changed, put in or left out."""
    syllable = lambda: rng.choice("bcdfglmnrst") + rng.choice("aeiou") + rng.choice(["", "n", "r", "s"])
    for n in [5, 6, 8, 8, 12, 20, 30, 45, 80] * 12:
        words = ["".join(syllable() for _ in range(rng.randint(1, 4))) for _ in range(n)]
        line = " ".join(words)
        for _ in range(9):
            other = list(words)
            k = rng.randrange(n)
            how = rng.randrange(3)
            other[k] = [other[k] + "x", other[k][1:] or "q", "".join(syllable() for _ in range(2))][how]
            text = " ".join(other)
            if text != line and 10 * edits(line, text) <= max(len(line), len(text)) and len(line) >= 20:
                yield line, text
                break


def test_line_recall_against_edit_similarity(make_docs):
    pairs = list(fuzzy_pairs(random.Random(11)))
    assert len(pairs) > 90
    docs = make_docs([(2 * i + j, line) for i, p in enumerate(pairs) for j, line in enumerate(p)])
    gone = {r["doc_id"] for r in drop_repeated_lines(docs).where("size(removed_lines) > 0").collect()}
    assert gone <= {2 * i + 1 for i in range(len(pairs))} and len(gone) >= 0.97 * len(pairs)


def test_short_and_unspaced_lines(make_docs):
    han = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(40))
    lines = ["Read more here", "READ more here!", "}", "}", "abc", "abc", "Share", "share", han, han[:20] + "丁" + han[21:]]
    out = drop_repeated_lines(make_docs([(i, line) for i, line in enumerate(lines)])).collect()
    assert {r["doc_id"] for r in out if r["removed_lines"]} == {1, 7, 9}


def test_edits_at_the_bound(spark, make_docs):
    assert spark.range(1).select(*[edit_room(F.lit(n), 0.9) for n in (19, 20, 50, 390)]).first()[:] == (1, 2, 5, 39)
    line = "table lamp carbon window market pencil garden stone"[:50]
    docs = make_docs([(1, line), (2, "XXXXX" + line[5:])])
    assert len(line) == 50 and drop_repeated_lines(docs).where("size(removed_lines) > 0").count() == 1
