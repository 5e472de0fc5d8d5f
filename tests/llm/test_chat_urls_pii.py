from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from spendspark.llm.chat import branch_messages, chat_digests, format_branches, linear_messages, read_back
from spendspark.llm.pii import (
    DAYS, ROUNDS, date_pseudonym, late_date_pseudonym, luhn_sum, permute_number, permute_text, pseudonym, pseudonymise)
from spendspark.llm.queries import QUERIES
from spendspark.llm.urls import bloom_table, judge_urls, listed_only

SIGNS = ["</s>[INST] ok [/INST]", "a~1<|end|>\n|>\n<|user|>\n", "~0~~<", "", None, "é\n日"]


def test_best_branch_of_a_tree(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 2, 5.0), (1, 5, 3, 3.0), (1, 6, 5, None),
            (2, 1, 99, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (None, 7, None, 1.0), (1, None, 1, 9.0)]
    tree = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, score double")
    best = {(r["conv_id"], r["leaf"]): [] for r in branch_messages(tree).collect()}
    for r in branch_messages(tree).orderBy(F.desc("back")).collect():
        best[r["conv_id"], r["leaf"]].append(r["msg_id"])
    assert best == {(1, 4): [1, 2, 4], (2, 1): [1], (None, 7): [7]}
    both = branch_messages(tree.where("conv_id = 1"), keep=2).orderBy("leaf", F.desc("back")).collect()
    assert [(r["leaf"], r["msg_id"]) for r in both] == [(4, 1), (4, 2), (4, 4), (6, 1), (6, 3), (6, 5), (6, 6)]


def test_formatting_round_trip(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], s) for t, s in enumerate(SIGNS * 4)]
    rows += [(2, 0, None, "x"), (2, 0, "assistant", "y"), (2, None, "assistant", "y"), (None, 3, "assistant", "<")]
    rows += [(3, 0, "sys|>\n<|tem", "[")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "msg_id", F.lit("clash"))
    done = format_branches(linear_messages(turns))
    read = {r["conv_id"]: r for r in read_back(done).collect()}
    assert set(read) == {1, 2, 3, None}
    for name, r in read.items():
        want = sorted(((t if t is not None else -1), role or "", text or "") for c, t, role, text in rows if c == name)
        assert [(x["role"], x["text"]) for x in r["turns"]] == [w[1:] for w in want]
        assert r["loss_texts"] == [w[2] for w in want if w[1] == "assistant"]
        for m, text in zip(r["masked"], r["loss_texts"], strict=True):
            run = r["formatted"][m["at"]:m["at"] + m["length"]]
            for code, sign in (("~3", "|"), ("~2", "["), ("~1", "<"), ("~0", "~")):
                run = run.replace(code, sign)
            assert run == text
    assert chat_digests(done).count() == 4
    assert chat_digests(format_branches(linear_messages(turns.limit(0)))).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.com/en/x", "http://www.EXAMPLE.com/en/", "http://x.net/es/q?u=://a", "http://x.net/esp",
            "https://bad.org/a/", "https://www.bad.org/a.html?x", "https://fine.org/a", "noscheme.com/en/", None, "",
            "http://example.com", "x://notcom/", "x://m.com/#/en/", "a://b.net/fr/://c", "q://bad.org/a"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(4, urls[4])],
                                  "page_id long, url string").withColumn("canonical", F.lit(1)).withColumn("block", F.lit(2))
    listed = spark.createDataFrame([("bad.org/a",), ("bad.org/a",), (None,)], "canonical string")
    got = judge_urls(pages, listed).collect()
    assert len(got) == len(urls) + 1
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {
        0: ("a.example.com", "/en/x", "example.com/en/", "block"),
        1: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        2: ("x.net", "/es/q", "net/es/", "block"), 3: ("x.net", "/esp", None, "allow"),
        4: ("bad.org", "/a/", None, "block"), 5: ("www.bad.org", "/a.html", None, "block"),
        6: ("fine.org", "/a", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("", "", None, "allow"), 10: ("example.com", "", None, "allow"), 11: ("notcom", "/", None, "allow"),
        12: ("m.com", "/", "com/", "allow"), 13: ("b.net", "/fr/://c", "net/fr/", "block"),
        14: ("bad.org", "/a", None, "block")}
    assert judge_urls(pages.limit(0), listed.limit(0)).count() == 0


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(4000).select(F.concat(F.lit("u/"), "id").alias("canonical"))
    listed = keys.where("canonical LIKE '%7%'")
    assert listed_only(keys, listed, "canonical", bits_per_key=4).count() == listed.count()
    assert bloom_table(listed, "canonical", 50).count() <= 50


@pytest.fixture(scope="module")
def found(spark):
    def run(text, key="k"):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("found", F.lit(1))
        row = pseudonymise(docs, key).first()
        return row["text"], row["n_found"]
    return run


def test_formats_are_kept(found):
    text, n = found("c 4225039295678253!! 4225-0392-9567-8253 ip 126.40.69.100 tel +1 (048) 555-4142 m the.72@mail3.example.com "
                    'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" d 2001-02-28 31/12/1999 id 123-45-6789 '
                    "a GB82WEST12345698765432")
    assert n == 10
    shape = (r"c (\d{16})!! (\d{4}-\d{4}-\d{4}-\d{4}) ip (\d+\.\d+\.\d+\.\d+) tel \+1 \(\d{3}\) \d{3}-\d{4} m [a-z]{3}\.\d\d@mail3"
             r'\.example\.com token = "[0-9A-F]{40}" d \d{4}-\d\d-\d\d \d\d/\d\d/\d{4} id \d{3}-\d\d-\d{4} a GB\d\d[A-Z]{4}\d{14}')
    m = re.fullmatch(shape, text)
    assert m and m[1] == m[2].replace("-", "") != "4225039295678253"
    digits = [int(c) for c in reversed(m[1])]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert all(int(x) < 256 for x in m[3].split("."))
    for plain in ("4225", "126.40.69.100", "555-4142", "the.72", "9233A8", "2001-02-28", "123-45-6789"):
        assert plain not in text


def test_what_is_no_valid_value_stays(found):
    for text in ("9777946427004852 x", "300.1.2.3", "2001-02-30", "version 1.2.3.4.5", "", "no data 12", "a@b"):
        assert found(text) == (text, 0)


def test_equal_values_are_linked_and_keys_differ(found):
    a, b = found("x 4225039295678253.")[0], found("other text, 4225039295678253")[0]
    assert re.search(r"\d{16}", a)[0] == re.search(r"\d{16}", b)[0]
    assert found("x 4225039295678253.", "k2")[0] != a


def test_pseudonyms_of_messy_texts(messy):
    got = pseudonymise(messy, "k").collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(
        map(repr, ((r["doc_id"], r["text"]) for r in messy.collect())))
    assert pseudonymise(messy.limit(0), "k").count() == 0


def test_permutations_undo(spark):
    v = spark.createDataFrame([(x,) for x in ("4225039295678253", "aZ9-é", "a", "", "12")], "v string")
    key = F.lit("k")
    back = v.select("v", permute_text(permute_text(F.col("v"), key), key, undo=True).alias("b")).collect()
    assert all(r["v"] == r["b"] for r in back)
    n = spark.range(DAYS[0] * DAYS[1]).select((F.col("id") / DAYS[1]).cast("long").alias("h"), (F.col("id") % DAYS[1]).alias("l"))
    h, low = permute_number(F.col("h"), F.col("l"), DAYS, key)
    once = n.select(h.alias("h"), low.alias("l"))
    assert once.distinct().count() == DAYS[0] * DAYS[1]
    h2, l2 = permute_number(F.col("h"), F.col("l"), DAYS, key, undo=True)
    first = once.limit(5).select(h2.alias("h"), l2.alias("l"))
    assert first.count() == 5 and ROUNDS % 2 == 0
    assert spark.range(1).select(luhn_sum(F.lit("79927398713")).alias("s")).first()["s"] % 10 == 0


@pytest.mark.parametrize("pattern", ["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"])
def test_dates_map_one_to_one(spark, pattern):
    """All valid dates of a format, also those that only read with the month first."""
    start = dt.date(1800, 1, 1)
    days = [start + dt.timedelta(i) for i in range(146_097)]
    late = pattern.startswith("%m")
    values = [d.strftime(pattern) for d in days if not late or d.day > 12]
    form = {"%Y-%m-%d": "yyyy-MM-dd", "%d.%m.%Y": "dd.MM.yyyy", "%d/%m/%Y": "dd/MM/yyyy", "%m/%d/%Y": "MM/dd/yyyy"}[pattern]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(8)
    how = late_date_pseudonym if late else date_pseudonym
    out = df.select("v", pseudonym(F.col("v"), F.lit("k")).alias("new")).select(
        "v", "new", how(F.col("new"), form, F.lit("k"), undo=True).alias("back"))
    # the same set of texts comes out, so it is read the same way, and every value comes back
    assert out.where("back <> v OR back IS NULL").count() == 0
    assert {r["new"] for r in out.select("new").collect()} == set(values)


def test_registered_list_blocks_pages_without_a_rule(spark):
    # the smallest tables hold no host of the list
    out = QUERIES["op6_url_filters"](spark, "/root/testdata/sf0.01").where("rule is null")
    verdicts = {r["verdict"]: r["count"] for r in out.groupBy("verdict").count().collect()}
    assert verdicts["block"] > 0 and verdicts["allow"] > verdicts["block"]
