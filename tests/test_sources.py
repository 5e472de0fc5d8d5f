from __future__ import annotations

import csv as pycsv
import io
import random
from datetime import datetime
from decimal import Decimal

import pytest

from spendspark.functions import fixed_values as fv
from spendspark.sources import csv_statement as csv
from spendspark.sources import registry
from spendspark.sources import text_statement as text

HEADER = "Date,Time,Transaction Details,Type,Amount,UTR\n"
FILES = {
    "plain.csv": HEADER + "\"Jan 05, 2024\",01:30 PM,Paid to X,DEBIT,10.50,U1\n",
    "preamble.csv": "Transaction Statement for 99\nDuration,Jan\n" + HEADER
    + "\"Jan 06, 2024\",,Paid to Y,DEBIT,20,\n,,,,,\n",
    "bom.csv": "﻿" + HEADER + "2024-01-07,,Received from Z,Cr,30,U3\n",
    "quoted.csv": HEADER + "2024-01-08,,\"Paid to\nA \"\"B\"\", C\",DEBIT,40,U4\n2024-01-09,,D,DEBIT,41,U5\n",
    "no_amount.csv": "Date,Total amount\n2024-01-01,5\n",
    "no_header.csv": "a,b\n1,2\n",
    "empty.csv": "",
    "short.csv": HEADER + "2024-01-10,,Paid to S,DEBIT,50\nbad,,x\n",
    "other_names.csv": "Txn Date,Date,Narration,Dr/Cr,Amount (INR),Merchant\n"
                       "2024-01-11,2024-12-31,n,dr,60,m\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("statements")
    for name, body in FILES.items():
        (root / name).write_text(body, encoding="utf-8")
    (root / "scan.pdf").write_bytes(b"%PDF-")
    (root / "notes.txt").write_text("hello")
    return root


def test_read_csv_statements(spark, folder):
    rows, unparsed = csv.read_csv_statements(spark, str(folder))
    got = {r["reference_id"] or r["counterparty_raw"]: r for r in rows.collect()}
    assert set(got) == {"U1", "Paid to Y", "U3", "U4", "U5", "Paid to S", "n"}
    first = got["U1"]
    assert (first["txn_date"], first["amount"], first["direction"]) == (
        datetime(2024, 1, 5, 13, 30), Decimal("10.50"), "debit")
    assert first["raw_line"] == (
        "Date=Jan 05, 2024 | Time=01:30 PM | Transaction Details=Paid to X | Type=DEBIT | "
        "Amount=10.50 | UTR=U1")
    assert got["U4"]["counterparty_raw"] == "Paid to\nA \"B\", C"
    assert got["U3"]["direction"] == "credit" and got["Paid to Y"]["reference_id"] is None
    assert got["Paid to S"]["raw_line"].endswith("Type=DEBIT | Amount=50")
    assert got["n"]["txn_date"] == datetime(2024, 1, 11)

    bad = {(r["source_file"].rsplit("/", 1)[1], r["reason"], r["raw_line"]) for r in unparsed.collect()}
    assert bad == {
        ("no_amount.csv", "CSV missing required 'amount' column", "Date,Total amount"),
        ("no_header.csv", fv.REASON_NO_HEADER, ""), ("empty.csv", fv.REASON_NO_HEADER, ""),
        ("short.csv", "unparseable date, unparseable amount, unknown direction",
         "Date=bad | Time= | Transaction Details=x"),
    }
    stats = {r["source_file"].rsplit("/", 1)[1]: r for r in csv.parse_stats(rows, unparsed).collect()}
    assert (stats["short.csv"]["parsed"], stats["short.csv"]["unparsed"],
            stats["short.csv"]["parse_rate"]) == (1, 1, 0.5)
    assert stats["empty.csv"]["parse_rate"] == 0.0


def test_amount_with_direction_but_no_date(spark):
    df = spark.createDataFrame(
        [("f", 0, 0, "x", None, " ", "cr", "5", " ", "raw", "app")],
        "source_file string, part_no long, row_no long, date_str string, time_str string, "
        "details_str string, type_str string, amount_str string, reference_str string, "
        "raw_line string, source_app string")
    row = csv.parse_fields(df).first()
    assert row["reason"] == "unparseable date"
    assert (row["counterparty_raw"], row["reference_id"]) == ("UNKNOWN", None)


@pytest.mark.parametrize("split_bytes", [64, 1 << 20])
def test_records_over_splits_match_csv_reader(spark, tmp_path, split_bytes):
    """Quoted commas, quotes and line breaks, with records that cross split borders."""
    rng = random.Random(5)
    rows = [[f"r{i}"] + ["".join(rng.choice('ab",\n ') for _ in range(rng.randint(0, 12))) for _ in range(3)]
            for i in range(120)]
    out = io.StringIO()
    pycsv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "x.csv").write_text(out.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        records = csv.scan_records(spark, str(tmp_path))
        got = [r["cells"] for r in records.orderBy("part_no", "row_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == rows


def test_equal_header_names_use_the_last(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Date,Amount,Amount,Type\n2024-01-01,1,2,dr\n")
    rows, _ = csv.read_csv_statements(spark, str(tmp_path))
    assert rows.first()["amount"] == Decimal("2.00")


def test_route_files(spark, folder):
    got = {r["source_file"].rsplit("/", 1)[1]: r["adapter"]
           for r in registry.route_files(spark, str(folder)).collect()}
    assert got["plain.csv"] == "csv" and got["preamble.csv"] == "csv"
    assert got["scan.pdf"] == "pdf"
    assert got["notes.txt"] is None and got["no_header.csv"] is None and got["empty.csv"] is None


PAGE = """Statement of May
Jan 05, 2024 Paid to A
INR 1,200.50 01:30 PM
Feb 06 2024 Refund from B ₹7
Mar 07, 2024 nothing here
Xyz 08, 2024 Paid to C Rs. 5
text with Jan 05, 2024 inside INR 1"""


def pages(spark, *texts):
    return spark.createDataFrame(
        [("f", i, t) for i, t in enumerate(texts)], "source_file string, part_no long, text string")


def test_text_records(spark):
    rows = text.text_rows(text.split_records(pages(spark, PAGE, "no dates", ""))).orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == [1, 2, 3, 4]
    assert rows[0]["raw_line"] == "Jan 05, 2024 Paid to A\nINR 1,200.50 01:30 PM"
    assert (rows[0]["amount"], rows[0]["direction"], rows[0]["counterparty_raw"]) == (
        Decimal("1200.50"), "debit", "A")
    assert (rows[1]["direction"], rows[1]["txn_date"]) == ("credit", datetime(2024, 2, 6))
    assert rows[2]["reason"] == fv.REASON_NO_FIELDS
    assert rows[3]["reason"] == fv.REASON_BAD_FIELDS
    kept = text.split_records(pages(spark, PAGE, "no dates"), keep_orphans=True)
    assert {(r["part_no"], r["record_no"], r["chunk"]) for r in kept.filter("record_no = 0").collect()} == {
        (0, 0, "Statement of May"), (1, 0, "no dates")}


def test_table_rows_with_fallback(spark):
    cells = spark.createDataFrame([
        ("f", 0, 1, ["Date", "Details", "Amount"]),
        ("f", 0, 2, ["Jan 05, 2024 ", " Paid to A", None, "₹10"]),
        ("f", 1, 1, ["heading only"]),
    ], "source_file string, part_no long, row_no long, cells array<string>")
    texts = pages(spark, "Jan 05, 2024 Paid to other INR 1", "Feb 06, 2024 Paid to T INR 2", "Mar 07, 2024 x")
    rows, unparsed = text.pages_with_fallback(cells, texts)
    got = {(r["part_no"], r["amount"], r["parse_confidence"], r["counterparty_raw"]) for r in rows.collect()}
    assert got == {(0, Decimal("10.00"), 1.0, "A"), (1, Decimal("2.00"), 0.7, "T")}
    assert [r["raw_line"] for r in unparsed.collect()] == ["Mar 07, 2024 x"]
    _, with_headings = text.pages_with_fallback(cells, texts, keep_orphans=True)
    assert {r["raw_line"] for r in with_headings.collect()} == {"Mar 07, 2024 x", "Date Details Amount"}


def numbered_statement(rng, n):
    """Rows with an id each: plain, quoted, with doubled quotes, line breaks and stray quotes."""
    names = ['Paid to "shop', 'a "b" c', '"Paid, to ""X"", Y"', '"two\nlines"', '"three\n\nlines ""q"""', 'x"', "plain",
             '"a" b', '""', '"ends with """', '5" pipe']
    return [(f"2024-01-{1 + i % 28:02d},,{rng.choice(names)},DEBIT,{i + 1}.00,R{i}") for i in range(n)]


@pytest.mark.parametrize("split_bytes", [64, 333, 1 << 20])
def test_stray_and_doubled_quotes_match_csv_reader(spark, tmp_path, split_bytes):
    text = HEADER + "\n".join(numbered_statement(random.Random(split_bytes), 150)) + "\n"
    (tmp_path / "x.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows, unparsed = csv.read_csv_statements(spark, str(tmp_path))
        got = {r["reference_id"]: (r["counterparty_raw"], int(r["amount"])) for r in rows.collect()}
        assert unparsed.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {r[5]: (r[2].strip() or "Unknown", int(float(r[4]))) for r in list(pycsv.reader(io.StringIO(text, newline="")))[1:] if r}
    assert len(want) == 150 and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[0] for k, v in got.items() if v[0] != fv.UNKNOWN} == {k: v[0] for k, v in want.items() if v[0] != "Unknown"}


@pytest.mark.parametrize("split_bytes", [200, 1 << 20])
def test_no_row_is_lost_to_an_unclosed_quote(spark, tmp_path, split_bytes):
    """400 rows behind a stray quote, and one cell that nothing closes: all come out."""
    lines = [f"2024-02-{1 + i % 28:02d},,Shop {i},DEBIT,{i + 1}.00,R{i}" for i in range(406)]
    lines[6] = lines[6].replace("Shop", 'Paid to "shop')
    (tmp_path / "a.csv").write_text(HEADER + "\n".join(lines) + "\n")
    lines[200] = lines[200].replace("Shop", '"Shop')
    (tmp_path / "b.csv").write_text(HEADER + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows, unparsed = csv.read_csv_statements(spark, str(tmp_path))
        stats = {r["source_file"].rsplit("/", 1)[1]: (r["parsed"], r["unparsed"])
                 for r in csv.parse_stats(rows, unparsed).collect()}
        listed = [r["raw_line"] for r in unparsed.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert stats == {"a.csv": (406, 0), "b.csv": (405, 1)}
    assert len(listed) == 1 and '"Shop 200' in listed[0]
