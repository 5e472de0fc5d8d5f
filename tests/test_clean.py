from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendspark.operators import clean as ops
from spendspark.operators.transfers import tag_offsets
from spendspark.plans.clean import clean_ledger

ROWS = ("source_file string, part_no long, row_no long, txn_date timestamp, amount decimal(14,2), "
        "direction string, counterparty_raw string, reference_id string, source_app string, "
        "parse_confidence double")


def ledger(spark, rows):
    full = [("f", 0, i, ts, Decimal(a), d, name, ref, "app", 1.0)
            for i, (ts, a, d, name, ref) in enumerate(rows)]
    return spark.createDataFrame(full, ROWS)


def brute_offsets(rows):
    hit = set()
    for i, (ts, a, d, *_ ) in enumerate(rows):
        if d != "debit":
            continue
        near = [(t, j) for j, (t, b, e, *_) in enumerate(rows)
                if e == "credit" and Decimal(b) == Decimal(a) and abs(t - ts) <= timedelta(days=2)]
        if near:
            hit |= {i, min(near)[1]}
    return hit


@pytest.mark.parametrize("seed", range(4))
def test_offsets_against_brute_force(spark, seed):
    """Few amounts, crowded instants, exact two-day borders."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    steps = [timedelta(seconds=rng.choice([1, 30, 60, 3600, 86400, 43200])) for _ in range(8)]
    rows = []
    for _ in range(300):
        ts = start + timedelta(days=rng.randint(0, [3, 12, 40, 400][seed])) + rng.choice(steps) * rng.randint(0, 3)
        rows.append((ts, str(rng.choice([5, 7, 9])), rng.choice(["debit", "debit", "credit"]), "x", None))
    got = {r["row_no"] for r in tag_offsets(ledger(spark, rows)).filter("is_offset").collect()}
    assert got == brute_offsets(rows)


def test_offset_borders(spark):
    t = datetime(2024, 3, 10, 12)
    two = timedelta(days=2)
    rows = [
        (t, "1", "debit", "a", None), (t + two, "1", "credit", "b", None),
        (t, "2", "debit", "a", None), (t + two + timedelta(microseconds=1), "2", "credit", "b", None),
        (t, "3", "debit", "a", None), (t - two, "3", "credit", "b", None),
        (t, "4", "debit", "a", None), (t, "4", "credit", "b", None), (t, "4", "credit", "c", None),
        (t, "5", "credit", "a", None), (t, "6", "debit", "a", None),
    ]
    got = {r["row_no"] for r in tag_offsets(ledger(spark, rows)).filter("is_offset").collect()}
    assert got == {0, 1, 4, 5, 6, 7}


def test_kinds(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (t, "1", "debit", "Paid to Shop", "a"), (t, "2", "credit", "Salary", "b"),
        (t, "3", "credit", "REFUND from Shop", "c"), (t, "4", "debit", "Paid to Self Account", "d"),
        (t, "5", "credit", "from my account", "e"), (t, "6", "debit", "SELFRIDGES", "f"),
        (t, "7", "debit", "Paid to Refund Desk", "g"),
    ]
    scrubbed = ops.add_scrubbed(ledger(spark, rows))

    def kinds(**kw):
        return [r["txn_kind"] for r in ops.rule_kinds(scrubbed, **kw).orderBy("row_no").collect()]

    assert kinds() == ["spend", "income", "refund", "self_transfer", "self_transfer",
                       "self_transfer", "spend"]
    assert kinds(whole_word=True)[5] == "spend"
    assert kinds(owner_terms=[])[3] == "spend"
    assert kinds(owner_terms=["S.OP"])[0] == "spend"


def test_first_of_each_and_overrides(spark):
    t = datetime(2024, 1, 1)
    rows = [(t, "1", "debit", "Paid to A", "r1"), (t, "1", "debit", "Paid to B", "r1"),
            (t, "1", "credit", "Paid to A", "r1")]
    first = ops.first_of_each(ops.add_keys(ledger(spark, rows)).repartition(3))
    assert sorted(r["row_no"] for r in first.collect()) == [0, 2]
    table = spark.createDataFrame([("a", "Alpha Inc")], "pattern string, merchant string")
    named = ops.apply_overrides(ops.add_scrubbed(ledger(spark, rows)), table).orderBy("row_no").collect()
    assert [r["counterparty_normalized"] for r in named] == ["Alpha Inc", "B", "Alpha Inc"]
    assert ops.apply_overrides(first, None) is first


def test_read_overrides(spark, tmp_path):
    assert ops.read_overrides(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "o.csv").write_text("pattern,merchant\nabc,Abc Stores\n")
    assert ops.read_overrides(spark, str(tmp_path / "o.csv")).first()["merchant"] == "Abc Stores"


def test_clean_ledger(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (t, "649", "debit", "Paid to Netflix Pvt Ltd", "u1"),
        (t, "649", "debit", "netflix.billing@okbank", "u1"),
        (t + timedelta(days=1), "100", "debit", "Paid to Savings", None),
        (t + timedelta(days=2), "100", "credit", "Received from Savings", None),
        (t, "20", "debit", "Paid to CHAI POINT", None), (t, "21", "debit", "CHAIPOINT", None),
        (t, "22", "debit", "Chai Point", None),
    ]
    out = {r["row_no"]: r for r in clean_ledger(ledger(spark, rows)).collect()}
    assert set(out) == {0, 2, 3, 4, 5, 6}
    assert out[2]["txn_kind"] == out[3]["txn_kind"] == "self_transfer"
    assert {out[i]["counterparty_normalized"] for i in (4, 5, 6)} == {"CHAI POINT"}
    assert out[0]["id"] == out[0]["dedup_key"]
    plain = clean_ledger(ledger(spark, rows), fuzzy_threshold=None)
    assert plain.filter("counterparty_normalized = 'CHAIPOINT'").count() == 1


def test_clean_is_independent_of_order_and_partitions(spark):
    rng = random.Random(1)
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(hours=rng.randint(0, 200)), str(rng.randint(1, 5)),
             rng.choice(["debit", "credit"]), rng.choice(["A@ok", "Bee@ok", "Self x", "Refund"]),
             rng.choice([None, "r1", "r2"])) for _ in range(200)]
    df = ledger(spark, rows)
    columns = ["row_no", "txn_kind", "counterparty_normalized", "dedup_key"]
    one = clean_ledger(df.coalesce(1)).select(*columns)
    many = clean_ledger(df.orderBy(F.rand(3)).repartition(7)).select(*columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_empty(spark):
    assert clean_ledger(ledger(spark, [])).count() == 0


def test_rows_are_spread_before_they_are_sorted(spark):
    """One split may unfold to very many rows: none sorts them all for its first or smallest."""
    rows = spark.createDataFrame(
        [("f", 0, i, datetime(2024, 1, 1, i % 24), Decimal(5), "credit" if i % 3 else "debit", f"n{i % 5}", None)
         for i in range(60)],
        "source_file string, part_no bigint, row_no bigint, txn_date timestamp, amount decimal(14,2), "
        "direction string, counterparty_raw string, reference_id string")

    def under_last(df, step):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan[plan.rindex(step):]

    first = ops.first_of_each(ops.add_keys(rows))
    assert "REPARTITION_BY_COL" in under_last(first, "WindowGroupLimit")
    tagged = tag_offsets(rows).where("is_offset")
    assert "REPARTITION_BY_COL" in under_last(tagged, "SortAggregate")
    assert first.count() == rows.selectExpr("date(txn_date)", "direction", "counterparty_raw").distinct().count()


def test_rows_are_dealt_out_once_by_the_join(spark):
    """The cleaned rows are not spread again after the join; only credits are sorted by their keys."""
    start = datetime(2024, 1, 1)
    rows = ledger(spark, [
        (start + timedelta(hours=i), "5.00", "credit" if i % 3 else "debit", f"n{i % 5}", None) for i in range(40)])
    df = clean_ledger(rows, fuzzy_threshold=None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan[:plan.index("SortMergeJoin")] and "LeftOuter" in plan
    debits = plan[plan.rindex("REPARTITION_BY_COL"):]
    assert "HashAggregate" in debits and "SortAggregate" not in debits
    assert df.count() == rows.selectExpr("date(txn_date)", "direction", "counterparty_raw").distinct().count()


def test_offsets_of_rows_without_date_amount_or_direction(spark):
    start = datetime(2024, 1, 1)
    rows = ledger(spark, [(start, "5.00", "debit", "a", None), (start, "5.00", "credit", "b", None),
                          (start, "5.00", "credit", "c", None), (start, "5.00", "debit", "d", None),
                          (start, "6.00", None, "e", None), (start, "6.00", "other", "f", None),
                          (start, "6.00", "credit", "g", None)])
    bare = rows.withColumn("txn_date", F.lit(None).cast("timestamp")).unionByName(
        rows.withColumn("amount", F.lit(None).cast("decimal(14,2)"))).withColumn("row_no", F.col("row_no") + 100)
    got = tag_offsets(rows.unionByName(bare.withColumn("row_no", F.monotonically_increasing_id() + 100)))
    assert got.count() == 21
    assert sorted(r["row_no"] for r in got.where("is_offset").collect()) == [0, 1, 3]
