from __future__ import annotations

import hashlib
import random
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendspark.functions import dates, money, text


def values(spark, strings, expr):
    rows = [(i, s) for i, s in enumerate(strings)]
    df = spark.createDataFrame(rows, "i int, s string").select("i", expr(F.col("s")).alias("v"))
    return [r["v"] for r in df.orderBy("i").collect()]


def test_mask_goldens(spark):
    cases = {
        "a@ybl": "a@ybl", "ab@ybl": "***@ybl", "abc@ybl": "***@ybl", "abcd@ybl": "abc***@ybl",
        "pay user.name@okbank now": "pay use***@okbank now",
        "user@ybl@ok": "use***@ybl@ok", "ab@cd.ef@gh": "***@cd***@gh",
        "x@1": "x@1", "": "", "no handle": "no handle", "one@aa two2@bb": "***@aa two***@bb",
    }
    assert values(spark, list(cases), text.mask_handles) == list(cases.values())


def test_mask_random_against_regex_walk(spark):
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab.@_- 1") for _ in range(rng.randint(0, 18))) for _ in range(2000)]

    def walk(s):
        return re.sub(
            "([a-zA-Z0-9._-]{2,})(@[a-zA-Z]+)",
            lambda m: (m[1][:3] + "***" if len(m[1]) > 3 else "***") + m[2], s)

    assert values(spark, strings, text.mask_handles) == [walk(s) for s in strings]


def test_scrub_goldens(spark):
    cases = {
        "Paid to Swiggy Order": "SWIGGY", "netflix@ybl": "NET", "abc@ybl": "UNKNOWN",
        "Payment to Foo Pvt Ltd": "FOO", "Paid to Store 12345": "STORE", "Paid to Store 123": "STORE 123",
        "Received from  A & B, Co.": "A & B CO", "Paid to Café Río": "CAFÉ RÍO",
        "to from Shop": "FROM SHOP", "": "UNKNOWN", "Reference": "REFERENCE", "ref txn upi": "UNKNOWN",
        "Paid to Shop - 2024": "SHOP", "दुकान": "द क न",
    }
    assert values(spark, list(cases), text.scrub_merchant) == list(cases.values())
    kept = values(spark, ["netflix@ybl"], lambda c: text.scrub_merchant(c, mask_first=False))
    assert kept == ["NETFLIX"]


def test_plain_names_scrub_like_any(spark):
    """A name of ASCII characters takes the plainer patterns; with a noise word it takes all."""
    rng = random.Random(8)
    parts = ["Paid to", "money sent to ", "TO", "from", " ", "  ", "\t", "\n", "\x0b", "\x1c", "-", "_", "&", ".", "***",
             "12345", "007", "2024", "Kiosk", "a", "Z9", "order", "reference", "UPI", "pvt", "'", "Shop", "é", "ı", "ſ"]
    strings = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(3000)]

    def walk(s):
        space = "[ \t\n\x0b\f\r]"
        phrases, noise = (text.any_word(x) for x in (text.fv.TXN_PHRASES, text.fv.NOISE_WORDS))
        n = re.sub(rf"^{space}*{phrases}{space}+", "", s, flags=re.I)
        n = re.sub(rf"(?:{space}|[-_])*\d{{4,}}(?=\n?\Z)", "", n)
        n = re.sub(rf"(?<![a-z0-9_]){noise}(?![a-z0-9_])", "", n, flags=re.I)
        n = re.sub(rf"{space}+", " ", re.sub(r"[^A-Za-z0-9_& \t\n\x0b\f\r]", " ", n)).strip(" ").upper()
        return n or "UNKNOWN"

    ascii_only = [s for s in strings if s.isascii()]
    assert len(ascii_only) > 1500
    assert values(spark, ascii_only, text.scrub_merchant) == [walk(s) for s in ascii_only]
    # a blank of another script in front keeps every pattern of the longer way
    longer = values(spark, ["\u3000" + s for s in ascii_only], text.scrub_merchant)
    assert longer == values(spark, [" " + s for s in ascii_only], text.scrub_merchant)


def test_hash_reference(spark):
    got = values(spark, ["UTR1", "", None], text.hash_reference)
    assert got == [hashlib.sha256(b"UTR1").hexdigest()[:16], None, None]


def test_dedup_key(spark):
    rows = [
        (datetime(2024, 1, 5, 13, 30), Decimal("649.50"), "debit", "Paid to X", "UTR1"),
        (datetime(2024, 1, 5, 13, 30), Decimal("649.50"), "debit", "Paid To " + "Y" * 60, None),
        (datetime(2024, 1, 5, 9, 0), Decimal("649.50"), "debit", "paid to " + "y" * 70, ""),
    ]
    df = spark.createDataFrame(
        rows, "t timestamp, a decimal(14,2), d string, n string, r string")
    keys = [r[0] for r in df.select(text.dedup_key(*[F.col(c) for c in "tadnr"])).collect()]
    by_ref = hashlib.sha256(b"ref:UTR1|debit|649.50").hexdigest()[:32]
    by_name = hashlib.sha256(
        ("2024-01-05|649.50|debit|paid to " + "y" * 60).encode()).hexdigest()[:32]
    assert keys[:2] == [by_ref, by_name] and keys[2] != by_name  # names differ after 60 letters
    short = [r[0] for r in df.select(text.dedup_key(*[F.col(c) for c in "tadnr"], name_length=40)).collect()]
    assert short[1] == short[2]


@pytest.mark.parametrize("date, time, want", [
    ("Jan 05, 2024", "01:30 PM", datetime(2024, 1, 5, 13, 30)),
    ("jan 5, 2024", "1:30 am", datetime(2024, 1, 5, 1, 30)),
    ("05 Jan 2024", "13:30:05", datetime(2024, 1, 5, 13, 30, 5)),
    ("05-01-2024", None, datetime(2024, 1, 5)),
    ("2024-1-5", "", datetime(2024, 1, 5)),
    ("05/01/2024", "12:00 AM", datetime(2024, 1, 5)),
    ("01/25/2024", "12:00 PM", datetime(2024, 1, 25, 12)),
    ("13/02/2024", None, datetime(2024, 2, 13)),
    ("5 January 2024", "00:00:59", datetime(2024, 1, 5, 0, 0, 59)),
    ("January  05,  2024", None, datetime(2024, 1, 5)),
    ("May 05, 2024", None, datetime(2024, 5, 5)),
    ("Jan 05, 2024", "25:99", datetime(2024, 1, 5)),
    ("Jan 05, 2024", "13:30", datetime(2024, 1, 5)),
    ("Jan 05, 2024 01:30 PM", None, None),
    ("Feb 30, 2024", None, None),
    ("Jan 05, 2024 x", None, None),
    ("05-01-24", None, None),
    ("not a date", "10:00:00", None),
    ("", None, None),
])
def test_parse_date(spark, date, time, want):
    from spendspark.sources.csv_statement import parse_fields

    df = spark.createDataFrame(
        [("f", 0, 0, date, time, "x", "DEBIT", "1", "", "raw", "app")],
        "source_file string, part_no long, row_no long, date_str string, time_str string, "
        "details_str string, type_str string, amount_str string, reference_str string, "
        "raw_line string, source_app string")
    assert parse_fields(df).first()["txn_date"] == want


def test_amount_and_direction(spark):
    amounts = {
        "₹1,234.50": "1234.50", "Rs. 12": "12.00", "Rs12": "12.00", "INR 7.129": "7.13", "-5": "5.00",
        "+5.5": "5.50", " 1e3 ": "1000.00", "": None, "abc": None, "NaN": None, "0": "0.00", "₹": None,
    }
    got = values(spark, list(amounts), money.parse_amount)
    assert got == [None if v is None else Decimal(v) for v in amounts.values()]
    kinds = ["DEBIT", " paid ", "-", "Cr", "+", "", "unknown", None]
    plus = values(spark, kinds, lambda c: money.infer_direction(c, F.lit(" +5")))
    assert plus == ["debit", "debit", "debit", "credit", "credit", "credit", "credit", "credit"]
    none = values(spark, kinds, lambda c: money.infer_direction(c, F.lit("5")))
    assert none == ["debit", "debit", "debit", "credit", "credit", None, None, None]


def test_number_text(spark):
    df = spark.createDataFrame([(0.25,), (1234567.5,), (-2.675,), (12.0,)], "x double")
    one = [r[0] for r in df.select(money.plain_text(F.col("x"), 1)).collect()]
    assert one == [f"{x:.1f}" for x in (0.25, 1234567.5, -2.675, 12.0)]
    whole = [r[0] for r in df.select(money.rupees(F.col("x"))).collect()]
    assert whole == [f"₹{x:,.0f}" for x in (0.25, 1234567.5, -2.675, 12.0)]


def test_text_counterparty(spark):
    cases = {
        "Jan 05, 2024 01:30 PM Paid to Chai Point INR 20.50": "Chai Point",
        "Jan 05, 2024 - Received from | Me, ₹5": "Me",
        "Jan 05, 2024 Debit ₹5": "UNKNOWN",
        "Jan 05, 2024 Credit Card Rs. 1,000": "Card",
    }
    assert values(spark, list(cases), text.text_counterparty) == list(cases.values())


def test_whole_days(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 2, 0, 0), datetime(2024, 1, 1, 0, 0, 1)),
         (datetime(2024, 1, 3, 0, 0), datetime(2024, 1, 1, 0, 0))], "b timestamp, a timestamp")
    assert [r[0] for r in df.select(dates.whole_days(F.col("b"), F.col("a"))).collect()] == [0, 2]
