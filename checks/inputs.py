"""Ledger-shaped inputs, derived by Spark from the whole given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _seconds(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderdate").cast("timestamp").alias("day"),
        "o_totalprice",
    )


def _k() -> Column:
    return F.col("k")


def _ts() -> Column:
    return F.col("day") + _seconds(_k() % 86400)


def _base_cents() -> Column:
    return (F.floor(F.col("o_totalprice") / 100) * 100 + _k() % 100).cast("bigint")


def _money(cents: Column) -> Column:
    return (cents / F.lit(100.0)).cast("decimal(14,2)")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows: one debit or credit per order, copies, transfer pairs, subscriptions."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    n_parts = parts.count()
    base = (
        _orders(spark, sf_dir)
        .join(parts, F.col("p_partkey") == _k() % n_parts)
        .select(
            "k", "name", _ts().alias("txn_date"),
            _money(_base_cents() * F.when(_k() % 97 == 0, 20).otherwise(1)).alias("amount"),
            F.when(_k() % 11 == 0, "credit").otherwise("debit").alias("direction"),
        )
    )
    name = F.col("name")
    counterparty = (
        F.when((F.col("direction") == "credit") & (_k() % 2 == 0), F.concat(F.lit("Refund from "), name))
        .when(F.col("direction") == "credit", F.concat(F.lit("Received from "), name))
        .when(_k() % 5 == 0, F.concat(F.lit("Payment to "), name, F.lit(" Pvt Ltd")))
        .when(_k() % 5 == 1, F.concat(name, F.lit("@ybl")))
        .when(_k() % 5 == 2, F.concat(F.lit("Paid to "), name, F.lit(" "), (10000 + _k() % 90000).cast("string")))
        .when(_k() % 5 == 3, F.upper(name))
        .otherwise(F.concat(F.lit("Paid to "), name))
    )
    # each order emits itself (0), and a copy (1) and a transfer credit (2) where due
    emitted = F.explode(F.filter(F.array(
        F.lit(0),
        F.when(_k() % 50 == 0, 1),
        F.when((_k() % 40 == 7) & (_k() % 11 != 0), 2),
    ), lambda e: e.isNotNull()))
    e = F.col("e")
    transfer = e == 2
    orders = base.withColumn("e", emitted).select(
        F.lit("orders").alias("source_file"), (_k() * 4 + e).alias("row_no"),
        (F.col("txn_date") + _seconds(F.when(transfer, 7200).otherwise(0))).alias("txn_date"),
        "amount", F.when(transfer, "credit").otherwise(F.col("direction")).alias("direction"),
        F.when(transfer, "Received from Self Account").otherwise(counterparty).alias("counterparty_raw"),
        F.when(~transfer & (_k() % 4 != 0), F.concat(F.lit("UTR"), _k().cast("string")))
        .alias("reference_id"))

    c, i = F.col("c_custkey"), F.col("i")
    subs = (
        table(spark, sf_dir, "customer")
        # twelve rows each: dealt out first, as few splits hold very many keys
        .select("c_custkey").repartition("c_custkey")
        .select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
        .select(
            F.lit("subs").alias("source_file"), (c * 12 + i).alias("row_no"),
            (F.lit("2024-01-01 09:00:00").cast("timestamp")
             + F.make_dt_interval((30 * i + (c + 7 * i) % 3 - 1).cast("int"))).alias("txn_date"),
            (100 + c % 500).cast("decimal(14,2)").alias("amount"),
            F.lit("debit").alias("direction"),
            F.concat(F.lit("Paid to Sub "),
                     F.translate(c.cast("string"), "0123456789", "abcdefghij")).alias("counterparty_raw"),
            F.concat(F.lit("SUB"), (c * 12 + i).cast("string")).alias("reference_id"),
        )
    )
    return orders.unionByName(subs).withColumns({
        "part_no": F.lit(0).cast("bigint"),
        "source_app": F.lit("statement"),
        "parse_confidence": F.lit(1.0),
    })


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw statement strings in many spellings, one per order."""
    ts = _ts()
    number = F.format_number(_base_cents() / F.lit(100.0), 2)
    date = (
        F.when(_k() % 8 == 0, F.date_format(ts, "MMM dd, yyyy"))
        .when(_k() % 8 == 1, F.date_format(ts, "dd MMM yyyy"))
        .when(_k() % 8 == 2, F.date_format(ts, "dd-MM-yyyy"))
        .when(_k() % 8 == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(_k() % 8 == 4, F.date_format(ts, "dd/MM/yyyy"))
        .when(_k() % 8 == 5, F.date_format(ts, "dd MMMM yyyy"))
        .when(_k() % 8 == 6, F.date_format(ts, "MMMM dd, yyyy"))
        .otherwise("not a date")
    )
    time = (
        F.when(_k() % 3 == 0, F.date_format(ts, "hh:mm a"))
        .when(_k() % 3 == 1, F.date_format(ts, "HH:mm:ss"))
    )
    amount = (
        F.when(_k() % 30 == 5, "")
        .when(_k() % 6 == 0, F.concat(F.lit("₹"), number))
        .when(_k() % 6 == 1, F.concat(F.lit("Rs. "), number))
        .when(_k() % 6 == 2, F.concat(F.lit("INR "), number))
        .when(_k() % 6 == 3, F.concat(F.lit("-"), number))
        .when(_k() % 6 == 4, number)
        .otherwise(F.concat(F.lit("+"), number))
    )
    kind = (
        F.when(_k() % 5 == 0, "DEBIT").when(_k() % 5 == 1, "Cr").when(_k() % 5 == 2, " paid ")
        .when(_k() % 5 == 3, "").otherwise("unknown")
    )
    return _orders(spark, sf_dir).select(
        F.concat(F.lit("statement-"), (_k() % 7).cast("string")).alias("source_file"),
        F.lit(0).cast("bigint").alias("part_no"), _k().alias("row_no"),
        date.alias("date_str"), time.alias("time_str"),
        F.concat(F.lit("Shop "), (_k() % 40).cast("string")).alias("details_str"),
        kind.alias("type_str"), amount.alias("amount_str"),
        F.when(_k() % 4 != 0, F.concat(F.lit("UTR"), _k().cast("string"))).otherwise("").alias("reference_str"),
        F.concat(F.lit("row="), _k().cast("string")).alias("raw_line"),
        F.lit("statement").alias("source_app"),
    )


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.format_number(_base_cents() / F.lit(100.0), 2)
    amount = (
        F.when(_k() % 9 == 0, "no amount")
        .when(_k() % 2 == 0, F.concat(F.lit("INR "), number))
        .otherwise(F.concat(F.lit("₹"), number))
    )
    line = F.concat(
        F.date_format(_ts(), "MMM dd, yyyy"), F.lit(" "),
        F.when(_k() % 4 == 0, "Received from").otherwise("Paid to"),
        F.lit(" Shop "), (_k() % 40).cast("string"), F.lit(" "), amount)
    return _orders(spark, sf_dir).select(
        F.lit("pages").alias("source_file"), F.floor(_k() / 10).alias("part_no"), "k",
        line.alias("line"))


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of text per ten orders."""
    return page_lines(spark, sf_dir).groupBy("source_file", "part_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))),
                                 lambda x: x["line"]), "\n").alias("text"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells of the even pages."""
    return page_lines(spark, sf_dir).filter("part_no % 2 = 0").select(
        "source_file", "part_no", F.col("k").alias("row_no"),
        F.split("line", " ").alias("cells"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a ledger: the user is the merchant, the value the amount."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("txn_date"),
        F.col("value").cast("decimal(14,2)").alias("amount"),
        F.col("user_id").alias("merchant"))
