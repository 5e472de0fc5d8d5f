"""Whole jobs on statement files: ingest, recluster, streams, scoring."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from spendspark import Tunables
from spendspark.operators import reads
from spendspark.operators.features import build_features
from spendspark.operators.insights import month_totals
from spendspark.plans.ingest import ingest_path
from spendspark.plans.recluster import recluster, recluster_store
from spendspark.plans.score import run_profile, score_new, stored_model
from spendspark.plans.store import LedgerStore
from spendspark.sources.csv_statement import read_csv_statements
from spendspark.plans.clean import clean_ledger
from spendspark.streaming.ingest_stream import ingest_stream
from spendspark.streaming.score_stream import score_stream

QUICK = Tunables(k_max=4, n_init=4, stability_seeds=3, stability_n_init=2)


ORDERS = "/root/testdata/sf0.001"
ODD_ID = "N-odd"


def statement(share=1, salt=0):
    """A statement of the given orders: every ``share``-th one, its clerk's part as the payee.

    One payee gets small even amounts and, once, one that is far too large.
    """
    con = duckdb.connect()
    rows = con.execute(f"""
        SELECT o_orderkey, p_name, o_totalprice, o_orderkey % 9 FROM '{ORDERS}/orders.parquet'
        JOIN '{ORDERS}/part.parquet' ON p_partkey = o_orderkey % 200
        WHERE o_orderkey % {share} = 0 AND o_orderkey < 900 ORDER BY 1""").fetchall()
    lines = ["Exported on request,,", "Date,Time,Transaction Details,Type,Amount,UTR"]
    for key, part, price, which in rows:
        day = datetime(2023, 2, 1) + timedelta(days=key // 5, minutes=7 * key % 1440)
        kind, payee = ("CREDIT", "Received from Harbour Works") if which == 8 else ("DEBIT", f"Paid to {part} store")
        if which < 3:
            payee, price = "Paid to corner newsagent", 1500 + 100 * (key % 7)
        lines.append(f"{day:%Y-%m-%d},{day:%H:%M:%S},{payee},{kind},{price / 50:.2f},N{salt}-{key}")
    lines.append(f"2023-03-03,10:00:00,Paid to corner newsagent,DEBIT,9100.00,{ODD_ID}{salt}")
    # money that goes out and comes back the same hour
    lines.append(f"2023-04-04,10:00:00,Paid to savings,DEBIT,777.77,N{salt}-out")
    lines.append(f"2023-04-04,10:40:00,Received from savings,CREDIT,777.77,N{salt}-in")
    return "\n".join(lines) + "\nno day,,x,DEBIT,1,N\n", len(rows) + 3


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ledger")
    files = root / "files"
    files.mkdir()
    text, n = statement()
    (files / "s.csv").write_text(text)
    store = LedgerStore(spark, str(root / "store"))
    (files / "scan.PDF").write_bytes(b"%PDF-")
    (files / "notes.txt").write_text("hello")
    first = ingest_path(spark, store, str(files), batch="b1")
    return root, store, n, first


def test_reader_and_kinds(spark, ingested):
    root, _, n, _ = ingested
    rows, unparsed = read_csv_statements(spark, str(root / "files"))
    assert (rows.count(), unparsed.count()) == (n, 1)
    cleaned = clean_ledger(rows)
    assert {r[0] for r in cleaned.select("txn_kind").distinct().collect()} == {"spend", "self_transfer", "income"}
    flags = {r[0] for r in build_features(cleaned).select("is_recurring").distinct().collect()}
    assert flags == {0.0, 1.0}


def test_ingest_twice_is_once(spark, ingested):
    root, store, n, first = ingested
    assert (first["parsed"], first["unparsed"], first["inserted"]) == (n, 3, n)
    assert first["parse_rate"] == round(n / (n + 3), 4)
    again = ingest_path(spark, store, str(root / "files"), batch="b1")
    assert (again["inserted"], again["duplicates_skipped"]) == (0, n)
    assert store.read("transactions").count() == n and store.read("unparsed").count() == 3
    reasons = {r["source_file"].rsplit("/", 1)[1]: r["reason"] for r in store.read("unparsed").collect()}
    assert set(reasons) == {"s.csv", "scan.PDF", "notes.txt"} and reasons["scan.PDF"] == "No reader for pdf files"


def test_file_added_in_the_same_session(spark, tmp_path):
    files, store = tmp_path / "in", LedgerStore(spark, str(tmp_path / "store"))
    files.mkdir()
    head = "Date,Type,Amount,Details\n"
    (files / "a.csv").write_text(head + "2024-09-01,dr,5,Shop A\nbroken,dr,1,x\n")
    assert ingest_path(spark, store, str(files), fuzzy_threshold=None)["inserted"] == 1
    (files / "b.csv").write_text("a note\n" + head + "".join(f"2024-09-{d:02d},dr,{d},Shop B\n" for d in range(2, 9)))
    again = ingest_path(spark, store, str(files), fuzzy_threshold=None)
    assert (again["inserted"], again["duplicates_skipped"]) == (7, 1)
    (files / "a.csv").unlink()
    (files / "c.csv").write_text("Date,Type,Amount,Details\nalso broken,dr,1,x\n")
    assert ingest_path(spark, store, str(files), fuzzy_threshold=None)["inserted"] == 0
    assert sorted(r["raw_line"].split("|")[0].strip() for r in store.read("unparsed").collect()) == [
        "Date=also broken", "Date=broken"]


def test_split_sizes_do_not_matter(spark, tmp_path):
    head = "Date,Type,Amount,Details\n"
    (tmp_path / "a.csv").write_text("preamble\n" * 30 + head + "".join(f"2024-09-01,dr,{i + 1},Shop\n" for i in range(500)))
    (tmp_path / "b.csv").write_text(head + "".join(f"2024-09-02,dr,{i + 1},Shop\n" for i in range(5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300b", "2k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows, unparsed = read_csv_statements(spark, str(tmp_path))
            spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
            assert (rows.count(), unparsed.count()) == (505, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_repeated_run_is_one(spark, tmp_path, ingested):
    _, filled, _, _ = ingested
    run = recluster(filled.read("transactions"), QUICK, run_id="same", created_at=datetime(2024, 7, 1))
    store = LedgerStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        store.write_run(run.run, run.clusters, run.assignments, run.insights, run.features)
    assert store.read("runs").count() == 1 and run.run.first()["metrics"]["silhouette_method"] == "squared"


def test_failed_write_leaves_the_former_run(spark, tmp_path, ingested):
    _, filled, _, _ = ingested
    rows = filled.read("transactions")
    store = LedgerStore(spark, str(tmp_path / "store"))
    assert store.features().count() == 0
    first = recluster(rows, QUICK, run_id="a", created_at=datetime(2024, 7, 1))
    store.write_run(first.run, first.clusters, first.assignments, first.insights, first.features)
    before = sorted(map(tuple, store.features().collect()))
    later = first.run.withColumns({"id": F.lit("b"), "created_at": F.lit(datetime(2024, 8, 1))})
    broken = first.insights.withColumns({"run_id": F.lit("b"), "body": F.expr("raise_error('lost')").cast("string")})
    parts = [df.withColumn("run_id", F.lit("b")) for df in (first.clusters, first.assignments)]
    half = first.features.limit(3)
    with pytest.raises(Exception, match="lost"):
        store.write_run(later, *parts, broken, half)
    assert sorted(map(tuple, store.features().collect())) == before
    store.write_run(later, *parts, first.insights.withColumn("run_id", F.lit("b")), half)
    assert store.features().count() == 3 and store.features("a").count() == len(before)


def test_recluster_store_and_reads(spark, ingested):
    _, store, _, _ = ingested
    result = recluster_store(store, QUICK, run_id="run-1", created_at=datetime(2024, 7, 1))
    assert 2 <= result["k"] <= 4 and 0.3 < result["silhouette"] <= 1 and 0 < result["mean_ari"] <= 1
    spend = store.read("transactions").filter("txn_kind = 'spend'")
    assert result["n_transactions"] == spend.count() == store.features().count()
    assert result["n_anomalies"] >= 1
    parts = [store.read(t) for t in ("runs", "transactions", "assignments", "clusters")]
    series = reads.spend_over_time(*parts)
    assert series.agg(F.sum("total")).first()[0] == spend.agg(F.sum("amount")).first()[0]
    assert store.read("clusters").agg(F.sum("n_transactions")).first()[0] == spend.count()
    assert 1 <= reads.list_insights(store.read("runs"), store.read("insights")).count() <= 8
    odd = reads.in_cluster(store.read("transactions"), store.read("runs"), store.read("assignments"), is_anomaly=True)
    assert odd.filter("amount = 9100").count() == 1
    run = store.read("runs").first()
    assert run["metrics"]["chosen_k"] == result["k"] and len(run["metrics"]["k_sweep"]) == 3
    recluster_store(store, QUICK, run_id="run-2", created_at=datetime(2024, 8, 1))
    assert reads.resolve_run(store.read("runs")) == "run-2"
    assert {r[0] for r in store.read("assignments").select("run_id").distinct().collect()} == {"run-1", "run-2"}

    # rows placed by the stored model land where the run put them
    scaler, centers = stored_model(store.read("runs"), store.read("clusters"), "run-1")
    placed = score_new(spend, run_profile(spend), scaler, centers).select("id", F.col("cluster_index").alias("c"))
    kept = store.read("assignments").filter("run_id = 'run-1'").withColumnRenamed("transaction_id", "id")
    assert placed.join(kept, "id").filter("c = cluster_index").count() == spend.count()
    new = spark.createDataFrame([("x", 100.0, "NEVER SEEN")], "id string, amount double, counterparty_normalized string")
    assert score_new(new, run_profile(spend), scaler, centers).first()["cluster_index"] is not None


def test_recluster_does_not_depend_on_partitions(spark, ingested):
    _, store, _, _ = ingested
    ledger = store.read("transactions")
    one = recluster(ledger.coalesce(1), QUICK, run_id="x", created_at=datetime(2024, 1, 1))
    many = recluster(ledger.repartition(7, "amount"), QUICK, run_id="x", created_at=datetime(2024, 1, 1))
    labels = [{r["transaction_id"]: r["is_anomaly"] for r in run.assignments.collect()} for run in (one, many)]
    assert labels[0] == labels[1]
    assert one.fit.k == many.fit.k and one.silhouette == pytest.approx(many.silhouette, abs=0.02)


def test_too_few_rows(spark, ingested):
    _, store, _, _ = ingested
    with pytest.raises(ValueError):
        recluster(store.read("transactions").filter("txn_kind = 'spend'").limit(2), QUICK)


def test_ingest_stream(spark, tmp_path):
    files, store = tmp_path / "in", LedgerStore(spark, str(tmp_path / "store"))
    files.mkdir()
    text, n = statement(4)
    (files / "a.csv").write_text(text)

    def run():
        query = ingest_stream(spark, store, str(files), str(tmp_path / "cp"), fuzzy_threshold=None)
        query.awaitTermination()

    run()
    assert store.read("transactions").count() == n
    assert store.read("unparsed").count() == 1
    (files / "b.csv").write_text(text)
    (files / "c.csv").write_text("Date,Type,Amount,Details\n2024-09-01,dr,5,New Shop\n")
    run()
    assert store.read("transactions").count() == n + 1
    assert store.read("unparsed").count() == 2
    # a second stream into the same store
    other = tmp_path / "other"
    other.mkdir()
    (other / "d.csv").write_text("Date,Type,Amount,Details\nnever,dr,5,New Shop\n")
    ingest_stream(spark, store, str(other), str(tmp_path / "cp2"), fuzzy_threshold=None).awaitTermination()
    assert store.read("unparsed").count() == 3


def test_score_stream(spark, ingested, tmp_path):
    _, store, _, _ = ingested
    spend = store.read("transactions").filter("txn_kind = 'spend'").select("id", "amount", "counterparty_normalized")
    run = recluster(store.read("transactions"), QUICK, run_id="s", created_at=datetime(2024, 1, 1))
    profile = run_profile(store.read("transactions").filter("txn_kind = 'spend'")).persist()
    spend.write.parquet(str(tmp_path / "in"))
    score_stream(spark, str(tmp_path / "in"), spend.schema, profile, run.scaler, run.fit.centers,
                 str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = score_new(spend, profile, run.scaler, run.fit.centers)
    assert sorted(map(tuple, streamed.select("id", "cluster_index").collect())) == sorted(
        map(tuple, batch.select("id", "cluster_index").collect()))


def test_totals_add_up(spark, ingested):
    _, store, _, _ = ingested
    rows = store.read("transactions").selectExpr("*", "0 as cluster_index", "'x' as label")
    assert month_totals(rows).agg(F.sum("total")).first()[0] == rows.agg(F.sum("amount")).first()[0]


def test_equal_bad_lines_are_listed_each(spark, tmp_path):
    """A file that gains bad lines equal to listed ones gets those listed, and no line twice."""
    store, folder = LedgerStore(spark, str(tmp_path / "store")), tmp_path / "in"
    folder.mkdir()
    head, good, bad = "Date,Details,Type,Amount\n", "2024-01-02,Paid to A,DEBIT,5\n", "never,Paid to B,DEBIT,x\n"

    def ingest(text):
        (folder / "a.csv").write_text(head + text)
        found = ingest_path(spark, store, str(folder))
        return found["parsed"], found["unparsed"], store.read("unparsed").count()

    assert ingest(good + bad + bad) == (1, 2, 2)
    assert ingest(good + bad + bad) == (1, 2, 2)
    assert ingest(bad + good + bad + "other,,,\n" + bad * 3) == (1, 6, 6)
    assert store.read("unparsed").groupBy("raw_line").count().orderBy("count").collect()[-1]["count"] == 5
