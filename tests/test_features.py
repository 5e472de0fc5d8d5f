"""Features of small ledgers whose values are counted by hand."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest

from spendspark.functions import fixed_values as fv
from spendspark.operators import features as ops

SCHEMA = "id string, txn_date timestamp, amount double, txn_kind string, counterparty_normalized string"
MONDAY = datetime(2024, 4, 1)
FIRST = 1.0  # recency of a merchant's first row: as long ago as can be


def ago(days):
    return math.log(1 + days) / math.log(10_000)


@pytest.fixture
def ledger(spark):
    def make(days_by_payee, amounts=None, hour=8):
        rows = []
        for payee, days in days_by_payee.items():
            paid = (amounts or {}).get(payee, [10.0] * len(days))
            rows += [(f"{payee}-{i}", MONDAY + timedelta(days=d, hours=hour), a, "spend", payee)
                     for i, (d, a) in enumerate(zip(days, paid))]
        return spark.createDataFrame(rows, SCHEMA)
    return make


def column(df, name):
    return {r["transaction_id"]: r[name] for r in ops.build_features(df).collect()}


@pytest.mark.parametrize("days, flag", [
    ([0, 7, 14], 1.0),            # each week
    ([0, 30, 60, 90], 1.0),       # each month
    ([0, 365, 730], 1.0),         # each year
    ([0, 8, 15, 23], 1.0),        # nearly each week
    ([0, 7], 0.0),                # two rows show no rhythm
    ([0, 0, 0, 7], 0.0),          # one gap only, the rest on one day
    ([0, 17, 34, 51], 0.0),       # even, but no known rhythm
    ([0, 2, 14, 16, 28], 0.0),    # a week on average, but uneven
    ([0, 9, 18], 1.0),            # within three tenths of a week
    ([0, 10, 20], 0.0),           # beyond
])
def test_rhythm_of_a_payee(ledger, days, flag):
    assert set(column(ledger({"P": days, "OTHER": [1, 5]}), "is_recurring").values()) <= {flag, 0.0}
    assert column(ledger({"P": days}), "is_recurring")["P-0"] == flag


def test_recency_counts_whole_days(ledger):
    got = column(ledger({"P": [0, 3, 3, 40], "Q": [2]}), "recency_days")
    assert got == pytest.approx({"P-0": FIRST, "P-1": ago(3), "P-2": 0.0, "P-3": ago(37), "Q-0": FIRST})


def test_almost_a_day_is_none(spark):
    rows = [("x", MONDAY, 1.0, "spend", "P"), ("y", MONDAY + timedelta(hours=23, minutes=59), 1.0, "spend", "P"),
            ("z", MONDAY + timedelta(hours=48), 1.0, "spend", "P")]
    got = column(spark.createDataFrame(rows, SCHEMA), "recency_days")
    assert got == pytest.approx({"x": FIRST, "y": 0.0, "z": ago(1)})


def test_frequency_and_stability(ledger):
    df = ledger({"EVEN": [0, 1, 2], "MIXED": [0, 1], "NIL": [0, 4], "WILD": [0, 1, 2, 3, 4]},
                {"EVEN": [9.0] * 3, "MIXED": [10.0, 30.0], "NIL": [0.0, 0.0], "WILD": [0.0, 0.0, 0.0, 0.0, 100.0]})
    n = column(df, "merchant_frequency")
    assert n["EVEN-0"] == pytest.approx(math.log(4)) and n["WILD-4"] == pytest.approx(math.log(6))
    stable = column(df, "amount_stability")
    # deviations over means: 0, 10 / 20, none of a mean of zero, 40 / 20
    assert [stable[k] for k in ("EVEN-1", "MIXED-0", "NIL-0", "WILD-0")] == pytest.approx([1.0, 0.5, 1.0, 0.0])


def test_calendar(ledger):
    df = ledger({"P": [0, 2, 29, -32]}, {"P": [0.0, math.e - 1, 5.0, 1.0]})
    rows = {r["transaction_id"]: r for r in ops.build_features(df).collect()}
    assert set(next(iter(rows.values())).asDict()) == {"transaction_id", *fv.FEATURE_COLUMNS}
    assert (rows["P-0"]["log_amount"], rows["P-1"]["log_amount"]) == pytest.approx((0.0, 1.0))
    # Monday, Wednesday; first and last of April, last of February of a leap year
    assert (rows["P-0"]["dow_sin"], rows["P-0"]["dow_cos"]) == pytest.approx((0.0, 1.0))
    assert rows["P-1"]["dow_sin"] == pytest.approx(math.sin(4 * math.pi / 7))
    assert [rows[f"P-{i}"]["day_of_month_norm"] for i in (0, 2, 3)] == pytest.approx([1 / 30, 1.0, 29 / 29])


def test_other_kinds_are_left_out(spark, ledger):
    income = spark.createDataFrame([("in", MONDAY, 5.0, "income", "P")], SCHEMA)
    assert set(column(ledger({"P": [0, 7]}).unionByName(income), "merchant_frequency")) == {"P-0", "P-1"}
    assert ops.build_features(ledger({"P": [0]}).limit(0)).count() == 0


def test_same_instant_ties_go_by_id(spark):
    t = datetime(2024, 1, 1)
    data = [("b", t, 1.0, "spend", "M"), ("a", t, 1.0, "spend", "M"), ("c", t + timedelta(days=3), 1.0, "spend", "M")]
    got = {r["id"]: r["gap_days"] for r in ops.recency(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {"a": None, "b": 0, "c": 3}


def test_profile_counts_rows(ledger):
    profile = {r["counterparty_normalized"]: r for r in ops.merchant_profile(ledger({"P": [0, 7, 14], "Q": [1]})).collect()}
    assert profile["P"]["n_transactions"] == 3 and profile["Q"]["amount_stability"] == 1.0


def test_rows_are_read_once(spark, ledger):
    """What makes the rows, like a name's scrubbing, is not done again for the join back."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    rows = ledger({"P": [0, 7, 14], "Q": [1]})
    for derive in (ops.build_features, ops.recency):
        seen.value = 0
        derive(rows.mapInPandas(touch, rows.schema)).write.format("noop").mode("overwrite").save()
        assert seen.value == 4
