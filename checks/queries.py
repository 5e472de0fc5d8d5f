"""Registered queries: every one reads the given tables whole."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark import Tunables
from spendspark.functions import fixed_values as fv
from spendspark.functions.text import hash_reference, mask_handles, scrub_merchant
from spendspark.functions.similarity import token_set_score
from spendspark.operators import anomaly, clean, features, insights, kmeans, labels, merchants
from spendspark.operators import projection, reads, reconcile, scaling, silhouette, stability
from spendspark.operators import transfers
from spendspark.operators.quantiles import exact_percentile
from spendspark.plans.clean import clean_ledger
from spendspark.plans.recluster import recluster
from spendspark.plans.score import run_profile, score_new
from spendspark.plans.ingest import ingest_path
from spendspark.plans.store import LedgerStore, new_rows
from spendspark.runtime import durable, scratch_path
from spendspark.sources import csv_statement as csv
from spendspark.sources import registry
from spendspark.sources import text_statement as text
from spendspark.streaming.ingest_stream import ingest_stream
from spendspark.streaming.score_stream import score_stream

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

COLUMNS = fv.CLUSTERING_COLUMNS
MERCHANT = "counterparty_normalized"
CUT = datetime(1998, 1, 1)


def present(df: DataFrame) -> DataFrame:
    """Output types both engines write alike: bigint, double (6 digits), text."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return present(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


# --- shared inputs ---------------------------------------------------------------
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned ledger without name grouping (`clean_ledger` has it)."""
    return clean_ledger(inputs.ledger(spark, sf_dir), fuzzy_threshold=None)


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).filter("txn_kind = 'spend'")


def ledger_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_features(cleaned(spark, sf_dir))


def merchant_hash() -> Column:
    return F.length(MERCHANT) + F.ascii(MERCHANT)


def run_parts(spark: SparkSession, sf_dir: str):
    """Two derived runs over the spend rows: (runs, transactions, assignments, clusters).

    Transactions are a stored table for these queries, hence written once."""
    rows = durable(spend(spark, sf_dir))
    amount = F.col("amount").cast("double")
    per_run = [("r1", 3), ("r2", 4)]
    numbers = F.explode(F.array(*[
        F.struct(F.lit(r).alias("run_id"), (merchant_hash() % m).alias("cluster_index"))
        for r, m in per_run]))
    assigned = rows.select(
        F.col("id").alias("transaction_id"), "amount", "txn_date", MERCHANT, numbers.alias("a"),
    ).select(
        "transaction_id", "a.run_id", "a.cluster_index",
        (amount / 1000).alias("distance_to_centroid"),
        F.log1p(amount).alias("pca_x"), (F.day("txn_date") / 31).alias("pca_y"),
        (F.col("amount") >= 20000).alias("is_anomaly"),
        F.when(F.col("amount") >= 20000, "large").alias("anomaly_reason"),
        "amount",
    )
    clusters = kmeans.cluster_totals(assigned, ["run_id", "cluster_index"]).withColumn(
        "label", F.concat(F.lit("Group "), F.chr(F.lit(65) + F.col("cluster_index"))))
    runs = clusters.groupBy("run_id").agg(
        F.sum("n_transactions").alias("n_transactions"),
        F.count("*").cast("int").alias("k"),
    ).select(
        F.col("run_id").alias("id"),
        F.when(F.col("run_id") == "r1", F.lit(datetime(2024, 6, 1)))
        .otherwise(F.lit(datetime(2024, 7, 1))).cast("timestamp").alias("created_at"),
        "k", "n_transactions")
    return runs, rows, assigned.drop("amount"), clusters


def insight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of run r2 with cluster, label and anomaly flag."""
    c = (merchant_hash() % 4).alias("cluster_index")
    return durable(spend(spark, sf_dir)).select(
        "id", "txn_date", "amount", MERCHANT, c,
        F.concat(F.lit("Group "), F.chr(F.lit(65) + merchant_hash() % 4)).alias("label"),
        ((F.col("amount") >= 20000) | (F.col("amount") % 50 == 0)).alias("is_anomaly"))


def run_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw centroids of a grouping of all features into six clusters by their numbers."""
    return kmeans.raw_centroids(grouped_features(spark, sf_dir), COLUMNS)


def grouped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features grouped by size and frequency of the merchant."""
    group = (
        F.when(F.col("is_recurring") == 1, 0)
        .when(F.col("log_amount") < 6, 1)
        .when(F.col("merchant_frequency") < 4.5, 2)
        .when(F.col("log_amount") < 7.5, 3)
        .when(F.col("log_amount") < 8.5, 4)
        .otherwise(5))
    return ledger_features(spark, sf_dir).withColumn("cluster_index", group)


# --- sources -----------------------------------------------------------------------
@query
def stmt_parse_date(spark, sf_dir):
    return csv.parse_fields(inputs.statements(spark, sf_dir)).select("row_no", "txn_date")


@query
def stmt_parse_amount(spark, sf_dir):
    return csv.parse_fields(inputs.statements(spark, sf_dir)).select("row_no", "amount")


@query
def stmt_direction(spark, sf_dir):
    return csv.parse_fields(inputs.statements(spark, sf_dir)).select("row_no", "direction")


@query
def stmt_route_unparsed(spark, sf_dir):
    parsed = csv.parse_fields(inputs.statements(spark, sf_dir))
    return csv.bad_rows(parsed).select("row_no", "raw_line", "reason")


@query
def stmt_parse_stats(spark, sf_dir):
    return csv.parsed_stats(csv.parse_fields(inputs.statements(spark, sf_dir)))


def _csv_folder(spark, sf_dir) -> str:
    """The statements as CSV files with headers in the shared folder."""
    folder = scratch_path(spark, "csv")
    s = inputs.statements(spark, sf_dir)
    s.select(
        F.col("date_str").alias("Date"), F.coalesce("time_str", F.lit("")).alias("Time"),
        F.concat(F.lit('Paid "'), "details_str", F.lit('", row '), F.col("row_no").cast("string"))
        .alias("Transaction Details"),
        F.col("type_str").alias("Type"), F.col("amount_str").alias("Amount (INR)"),
        F.col("reference_str").alias("UTR"),
    ).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    return folder


@query
def stmt_csv_scan(spark, sf_dir):
    """Statement files written and read back: good and bad rows together."""
    rows, unparsed = csv.read_csv_statements(spark, _csv_folder(spark, sf_dir))
    return rows.select(
        "counterparty_raw", "txn_date", "amount", "direction", "reference_id",
        F.lit(None).cast("string").alias("reason"),
    ).unionByName(unparsed.select(
        F.regexp_extract("raw_line", r"Details=(.*) \| Type=", 1).alias("counterparty_raw"),
        F.lit(None).cast("timestamp").alias("txn_date"),
        F.lit(None).cast("decimal(14,2)").alias("amount"),
        F.lit(None).cast("string").alias("direction"),
        F.lit(None).cast("string").alias("reference_id"), "reason"))


@query
def stmt_header_map(spark, sf_dir):
    """Column positions found in the files, with the data rows that follow each header."""
    records = csv.scan_records(spark, _csv_folder(spark, sf_dir), "*.csv")
    headers = csv.map_header(csv.find_headers(records))
    fields = list(fv.HEADER_ALIASES)
    rows = csv.name_fields(records, csv.find_headers(records)).groupBy("source_file").agg(
        F.count("*").alias("n"))
    return headers.join(rows, "source_file").groupBy(*[f"{f}_at" for f in fields]).agg(
        F.sum("n").alias("n_rows"))


@query
def route_files(spark, sf_dir):
    """Rows behind each reader's files (files no reader takes hold none of them)."""
    folder = _csv_folder(spark, sf_dir)
    lines = csv.read_lines(spark, folder, "*.csv").filter("line not like 'Date,%'")
    return registry.route_files(spark, folder).join(lines, "source_file").groupBy(
        "adapter", "reason").agg(F.count("*").alias("n_rows"))


@query
def text_split_records(spark, sf_dir):
    return text.split_records(inputs.pages_text(spark, sf_dir)).select(
        "part_no", "record_no", "chunk")


@query
def text_extract_fields(spark, sf_dir):
    rows = text.text_rows(text.split_records(inputs.pages_text(spark, sf_dir)))
    return rows.select(
        "part_no", "row_no", "txn_date", "amount", "direction", "parse_confidence", "raw_line",
        "reason")


@query
def text_counterparty(spark, sf_dir):
    rows = text.text_rows(text.split_records(inputs.pages_text(spark, sf_dir)))
    return rows.select("part_no", "row_no", "counterparty_raw")


@query
def table_rows_with_fallback(spark, sf_dir):
    rows, unparsed = text.pages_with_fallback(
        inputs.page_tables(spark, sf_dir), inputs.pages_text(spark, sf_dir))
    return rows.select(
        "part_no", "row_no", "txn_date", "amount", "direction", "counterparty_raw",
        "parse_confidence", F.lit(None).cast("string").alias("reason"),
    ).unionByName(unparsed.select(
        "part_no", "row_no", F.lit(None).cast("timestamp").alias("txn_date"),
        F.lit(None).cast("decimal(14,2)").alias("amount"),
        F.lit(None).cast("string").alias("direction"),
        F.lit(None).cast("string").alias("counterparty_raw"),
        F.lit(None).cast("double").alias("parse_confidence"), "reason"))


@query
def ingest_antijoin(spark, sf_dir):
    """Rows of the whole ledger that a store holding its even rows does not know."""
    rows = clean.first_of_each(clean.add_keys(inputs.ledger(spark, sf_dir)))
    stored = clean.add_keys(inputs.ledger(spark, sf_dir).filter("row_no % 2 = 0"))
    return new_rows(rows, stored).select("dedup_key", "source_file", "row_no", "amount")


# --- cleaning ------------------------------------------------------------------------
@query
def mask_handles_documents(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", mask_handles(F.col("text")).alias("text"))


@query
def hash_references(spark, sf_dir):
    return inputs.ledger(spark, sf_dir).select(
        "source_file", "row_no", hash_reference(F.col("reference_id")).alias("reference_hash"))


@query
def dedup_keys(spark, sf_dir):
    return clean.add_keys(inputs.ledger(spark, sf_dir)).select("source_file", "row_no", "dedup_key")


@query
def dedup_first(spark, sf_dir):
    return clean.first_of_each(clean.add_keys(inputs.ledger(spark, sf_dir))).select(
        "dedup_key", "source_file", "row_no")


@query
def merchant_scrub(spark, sf_dir):
    return inputs.ledger(spark, sf_dir).select(
        "source_file", "row_no", scrub_merchant(F.col("counterparty_raw")).alias("merchant"))


@query
def merchant_scrub_unmasked(spark, sf_dir):
    """Scrub with handles kept whole, over document texts as well as ledger names."""
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("text").alias("t"))
    names = inputs.ledger(spark, sf_dir).select(F.col("counterparty_raw").alias("t"))
    handles = docs.select(F.explode(F.regexp_extract_all(
        "t", F.lit(r"[a-zA-Z0-9._-]+@[a-zA-Z]+"), F.lit(0))).alias("t"))
    return names.unionByName(handles) \
        .select(scrub_merchant(F.col("t"), mask_first=False).alias("merchant")) \
        .groupBy("merchant").agg(F.count("*").alias("n"))


@query
def merchant_override(spark, sf_dir):
    """Overrides read from the parts table: one hand-made name per part name."""
    rows = clean.add_scrubbed(inputs.ledger(spark, sf_dir))
    table = inputs.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("pattern")).agg(
        F.min("p_brand").alias("merchant"))
    return clean.apply_overrides(rows, table).select("source_file", "row_no", MERCHANT)


@query
def txn_kind_rules(spark, sf_dir):
    rows = clean.add_scrubbed(inputs.ledger(spark, sf_dir))
    return clean.rule_kinds(clean.mask_names(rows)).select("source_file", "row_no", "txn_kind")


@query
def txn_offset_pairs(spark, sf_dir):
    return transfers.tag_offsets(inputs.ledger(spark, sf_dir)).select(
        "source_file", "row_no", "is_offset")


@query
def token_set_pairs(spark, sf_dir):
    """Each distinct counterparty text scored against its scrubbed name."""
    names = inputs.ledger(spark, sf_dir).select(
        F.upper("counterparty_raw").alias("raw"),
        scrub_merchant(F.col("counterparty_raw")).alias("merchant")).distinct()
    return token_set_score(names, "raw", "merchant")


@query
def merchant_fuzzy_groups(spark, sf_dir):
    rows = clean.add_scrubbed(inputs.ledger(spark, sf_dir))
    return merchants.canonical_names(merchants.name_counts(rows))


@query
def clean_ledger_full(spark, sf_dir):
    return clean_ledger(inputs.ledger(spark, sf_dir)).select(
        "id", "txn_date", "amount", "direction", "txn_kind", "counterparty_raw", MERCHANT,
        "reference_hash", "source_file", "row_no")


# --- features ------------------------------------------------------------------------
@query
def features_calendar(spark, sf_dir):
    return features.calendar_features(inputs.ledger(spark, sf_dir)).select(
        "source_file", "row_no", "log_amount", "dow_sin", "dow_cos", "day_of_month_norm")


@query
def merchant_profile(spark, sf_dir):
    return features.merchant_profile(spend(spark, sf_dir)).select(
        MERCHANT, "n_transactions", "mean_amount", "merchant_frequency", "amount_stability")


@query
def recurring_merchants(spark, sf_dir):
    return features.merchant_profile(spend(spark, sf_dir)).select(
        MERCHANT, "n_gaps", "gap_mean", "gap_std", "is_recurring")


@query
def recency(spark, sf_dir):
    return features.recency(spend(spark, sf_dir)).select(
        "id", F.coalesce("gap_days", F.lit(-1)).alias("gap_days"), "recency_days")


@query
def recency_events(spark, sf_dir):
    return features.recency(inputs.event_ledger(spark, sf_dir), merchant="merchant").select(
        "id", F.coalesce("gap_days", F.lit(-1)).alias("gap_days"), "recency_days")


@query
def build_features(spark, sf_dir):
    return ledger_features(spark, sf_dir)


# --- clustering ------------------------------------------------------------------------
@query
def standardise(spark, sf_dir):
    f = durable(ledger_features(spark, sf_dir))
    return scaling.standardise(f).select("transaction_id", *COLUMNS)


def _scaled(spark, sf_dir) -> DataFrame:
    f = durable(ledger_features(spark, sf_dir).select("transaction_id", *COLUMNS))
    return scaling.standardise(f).persist()


@query
def kmeans_clusters(spark, sf_dir):
    x = _scaled(spark, sf_dir)
    fit = kmeans.fit_kmeans(x, COLUMNS, k=3)
    return kmeans.assign_columns(x, COLUMNS, fit.centers).select(
        "transaction_id", "cluster_index", "distance_to_centroid")


@query
def k_sweep(spark, sf_dir):
    _, sweep = kmeans.sweep_k(_scaled(spark, sf_dir), COLUMNS)
    return kmeans.sweep_frame(spark, sweep)


def _label_centers(v: DataFrame) -> list[list[float]]:
    """Mean vector per label (ten labels) in label order."""
    means = (
        v.select("label", F.posexplode("v").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg("x").alias("m"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
        .orderBy("label")
    )
    return [[p["m"] for p in r["c"]] for r in means.collect()]


def _assigned_vectors(spark, sf_dir) -> DataFrame:
    v = inputs.vectors(spark, sf_dir)
    return kmeans.assign_vectors(v, "v", _label_centers(v))


@query
def assign_centroid(spark, sf_dir):
    return _assigned_vectors(spark, sf_dir).select(
        "vec_id", "cluster_index", "distance_to_centroid")


def _wide(v: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [f"x{i}" for i in range(64)]
    return v.select("*", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)]), names


@query
def silhouette_embeddings(spark, sf_dir):
    points, names = _wide(inputs.vectors(spark, sf_dir))
    s = silhouette.silhouettes(points, names, ["label"])[0]
    return spark.createDataFrame(
        [(s["n_points"], s["silhouette"])], "n long, silhouette double")


@query
def silhouette_points(spark, sf_dir):
    points, names = _wide(inputs.vectors(spark, sf_dir))
    scored, _ = silhouette.point_silhouettes(points, names, ["label"])
    return scored.groupBy(F.col("_l0").alias("label")).agg(
        F.sum("_w").alias("n"), (F.sum(F.col("_w") * F.col("_v0")) / F.sum("_w")).alias("silhouette"))


@query
def ari_pairs(spark, sf_dir):
    return stability.adjusted_rand(_assigned_vectors(spark, sf_dir), "label", "cluster_index")


@query
def stability_scores(spark, sf_dir):
    x = _scaled(spark, sf_dir)
    fit = kmeans.fit_kmeans(x, COLUMNS, k=3)
    scores = stability.stability(x, COLUMNS, fit)
    return spark.createDataFrame(list(enumerate(scores or [])), "subsample int, ari double")


@query
def centroids_raw(spark, sf_dir):
    return run_centroids(spark, sf_dir)


@query
def pca_2d(spark, sf_dir):
    placed, _ = projection.pca_2d(_scaled(spark, sf_dir), COLUMNS)
    return placed.select("transaction_id", "pca_x", "pca_y")


def _run_before_cut(spark, sf_dir):
    """Rows from a date on, with profile, scaler and centers of a run fitted before it."""
    rows = durable(spend(spark, sf_dir))
    old, new = rows.filter(F.col("txn_date") < F.lit(CUT)), rows.filter(F.col("txn_date") >= F.lit(CUT))
    f = durable(features.build_features(old))
    scaler = scaling.fit_scaler(f)
    group = F.when(F.col("log_amount") < 6, 0).when(F.col("log_amount") < 8, 1).otherwise(2)
    means = kmeans.raw_centroids(scaler.transform(f.withColumn("cluster_index", group)), COLUMNS)
    centers = [[r[c] for c in COLUMNS] for r in means.orderBy("cluster_index").collect()]
    return new.select("id", "amount", MERCHANT), run_profile(old), scaler, centers


@query
def score_new_rows(spark, sf_dir):
    """A run fitted before a date places the rows from that date on."""
    return score_new(*_run_before_cut(spark, sf_dir)).select(
        "id", "cluster_index", "distance_to_centroid")


@query
def score_stream_rows(spark, sf_dir):
    """The same rows, arriving as a stream of files."""
    new, profile, scaler, centers = _run_before_cut(spark, sf_dir)
    arriving, scored, progress = (scratch_path(spark, n) for n in ("arriving", "scored", "progress"))
    new.write.parquet(arriving)
    score_stream(spark, arriving, new.schema, durable(profile), scaler, centers, scored, progress).awaitTermination()
    return spark.read.parquet(scored).select("id", "cluster_index", "distance_to_centroid")


# --- anomalies -------------------------------------------------------------------------
@query
def dbscan_eps(spark, sf_dir):
    """Eps of the embeddings (all dimensions) and of the scaled ledger features."""
    v, names = _wide(inputs.vectors(spark, sf_dir))
    mean = list(v.agg(*[F.avg(n) for n in names]).first())
    x = _scaled(spark, sf_dir)
    rows = [
        ("embeddings", anomaly.density_eps(v, names, mean)),
        ("ledger", anomaly.density_eps(x, COLUMNS, [0.0] * 4)),
    ]
    return spark.createDataFrame(rows, "input string, eps double")


@query
def amount_percentiles(spark, sf_dir):
    """Exact percentiles of event values and ledger amounts."""
    events = inputs.event_ledger(spark, sf_dir).select(F.col("amount").cast("double").alias("x"))
    ledger = inputs.ledger(spark, sf_dir).select(F.col("amount").cast("double").alias("x"))
    rows = [
        (name, p, exact_percentile(df, "x", p))
        for name, df in (("events", events.persist()), ("ledger", ledger.persist()))
        for p in (0.1, 0.5, 0.9)]
    return spark.createDataFrame(rows, "input string, p double, value double")


@query
def density_outliers(spark, sf_dir):
    x = _scaled(spark, sf_dir)
    eps = anomaly.density_eps(x, COLUMNS, [0.0] * 4)
    return anomaly.density_outliers(x, COLUMNS, eps=eps)


@query
def density_outliers_fine(spark, sf_dir):
    """A twentieth of the default radius: many of points need their neighbours looked up."""
    x = _scaled(spark, sf_dir)
    eps = anomaly.density_eps(x, COLUMNS, [0.0] * 4) / 20
    return anomaly.density_outliers(x, COLUMNS, eps=eps)


@query
def robust_z(spark, sf_dir):
    rows = durable(spend(spark, sf_dir).select("id", MERCHANT, "amount"))
    return anomaly.robust_z(rows).select("id", "z", "is_unusual", "z_reason")


@query
def robust_z_events(spark, sf_dir):
    return anomaly.robust_z(inputs.event_ledger(spark, sf_dir), merchant="merchant").select(
        "id", "z", "is_unusual")


@query
def anomalies(spark, sf_dir):
    rows = durable(spend(spark, sf_dir).withColumn("transaction_id", F.col("id")))
    x = scaling.standardise(
        durable(features.build_features(rows).select("transaction_id", *COLUMNS))).persist()
    eps = anomaly.density_eps(x, COLUMNS, [0.0] * 4) / 20
    noise = anomaly.density_outliers(x, COLUMNS, eps=eps)
    return anomaly.flag_anomalies(rows, noise).select(
        "transaction_id", "is_anomaly", "anomaly_reason")


# --- labels ----------------------------------------------------------------------------
@query
def centroid_buckets(spark, sf_dir):
    return labels.bucket_centroids(run_centroids(spark, sf_dir)).select(
        "cluster_index", *[f"{c}_bucket" for c in COLUMNS])


@query
def centroid_summary(spark, sf_dir):
    return labels.summarise_centroids(run_centroids(spark, sf_dir)).select(
        "cluster_index", "avg_amount", "typical_frequency", "recurring_share", "stability")


@query
def cluster_labels(spark, sf_dir):
    return labels.rule_label(labels.bucket_centroids(run_centroids(spark, sf_dir))).select(
        "cluster_index", "label")


@query
def label_suffix(spark, sf_dir):
    return labels.label_clusters(run_centroids(spark, sf_dir)).select("cluster_index", "label")


@query
def cluster_rollup(spark, sf_dir):
    _, _, _, clusters = run_parts(spark, sf_dir)
    return clusters.select("run_id", "cluster_index", "n_transactions", "total_amount")


# --- insights ----------------------------------------------------------------------------
@query
def cluster_month_totals(spark, sf_dir):
    return insights.month_totals(insight_rows(spark, sf_dir))


@query
def insight_trend(spark, sf_dir):
    return insights.trend_insights(insight_rows(spark, sf_dir))


@query
def insight_new_merchant(spark, sf_dir):
    return insights.new_merchant_insights(insight_rows(spark, sf_dir))


@query
def insight_anomaly(spark, sf_dir):
    return insights.anomaly_insights(insight_rows(spark, sf_dir))


@query
def insights_top(spark, sf_dir):
    return insights.top_insights(insights.all_insights(insight_rows(spark, sf_dir)))


# --- reads -------------------------------------------------------------------------------
@query
def latest_run(spark, sf_dir):
    return reads.latest_run(run_parts(spark, sf_dir)[0])


@query
def list_runs(spark, sf_dir):
    return reads.list_runs(run_parts(spark, sf_dir)[0])


@query
def list_clusters(spark, sf_dir):
    runs, _, _, clusters = run_parts(spark, sf_dir)
    return reads.list_clusters(runs, clusters)


@query
def scatter_points(spark, sf_dir):
    return reads.scatter_points(*run_parts(spark, sf_dir))


@query
def spend_over_time(spark, sf_dir):
    return reads.spend_over_time(*run_parts(spark, sf_dir))


@query
def spend_pivot(spark, sf_dir):
    names = ["Group A", "Group B", "Group C", "Group D"]
    return reads.spend_pivot(reads.spend_over_time(*run_parts(spark, sf_dir)), names) \
        .select("month", *[F.col(n).alias(n.replace(" ", "_").lower()) for n in names])


@query
def txns_filtered(spark, sf_dir):
    return reads.filter_transactions(
        cleaned(spark, sf_dir), datetime(1996, 1, 1), datetime(2000, 6, 30), "spend", "re_ %"
    ).select("id", "txn_date", MERCHANT)


@query
def txns_in_cluster(spark, sf_dir):
    runs, rows, assigned, _ = run_parts(spark, sf_dir)
    return reads.in_cluster(rows, runs, assigned, 2, True).select("id", "amount", MERCHANT)


@query
def txns_page(spark, sf_dir):
    return reads.page(cleaned(spark, sf_dir), limit=500, offset=500).select("id", "txn_date")


@query
def txns_by_amount(spark, sf_dir):
    return reads.by_amount(reads.page(cleaned(spark, sf_dir))).select("id", "amount", "txn_date")


@query
def list_insights(spark, sf_dir):
    runs = run_parts(spark, sf_dir)[0]
    rows = insights.all_insights(insight_rows(spark, sf_dir)).withColumn("run_id", F.lit("r2"))
    return reads.list_insights(runs, rows, month="1998-03").drop("run_id")


@query
def unparsed_queue(spark, sf_dir):
    s = inputs.statements(spark, sf_dir)
    bad = csv.bad_rows(csv.parse_fields(s))
    queued = bad.withColumn("created_at", F.timestamp_seconds(F.col("row_no") % 1000 * 3600))
    return reads.unparsed_queue(queued).select("row_no", "raw_line", "reason", "created_at")


# --- reconciliation ----------------------------------------------------------------------
def _truth_and_parsed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    truth = inputs.ledger(spark, sf_dir)
    k = F.floor(F.col("row_no") / 4)
    copies = F.when(k % 13 == 0, 0).when(k % 29 == 0, 2).otherwise(1)
    return truth, truth.withColumn("_c", F.explode(F.array_repeat(F.lit(1), copies))).drop("_c")


@query
def reconcile_summary(spark, sf_dir):
    return reconcile.reconcile_summary(*_truth_and_parsed(spark, sf_dir))


@query
def reconcile_misses(spark, sf_dir):
    return reconcile.reconcile_misses(*_truth_and_parsed(spark, sf_dir))


@query
def multiset_common(spark, sf_dir):
    return reconcile.common_rows(*_truth_and_parsed(spark, sf_dir))


@query
def multiset_missing(spark, sf_dir):
    return reconcile.missing_rows(*_truth_and_parsed(spark, sf_dir))


# --- jobs --------------------------------------------------------------------------------
def _statement_files(spark, sf_dir, path: str, rule: str) -> None:
    """One statement line per order that ``rule`` takes, as CSV files under ``path``."""
    orders = inputs.table(spark, sf_dir, "orders").where(rule)
    day = F.when(F.col("o_orderkey") % 10 == 3, "some day").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    (orders.select(day.alias("Date"), F.concat(F.lit("Paid to shop "), F.col("o_orderkey") % 40).alias("Details"),
                   F.lit("debit").alias("Type"), F.col("o_totalprice").cast("decimal(14,2)").alias("Amount"),
                   F.concat(F.lit("UTR"), "o_orderkey").alias("UTR"))
     .write.mode("append").option("header", True).csv(path))


@query
def ingest_outcome(spark, sf_dir):
    """Statement files ingested twice; the second time a seventh of the orders is new."""
    path, store = scratch_path(spark, "files"), LedgerStore(spark, scratch_path(spark, "store"))
    out = []
    for call, rule in enumerate(["o_orderkey % 7 <> 6", "o_orderkey % 7 = 6"]):
        _statement_files(spark, sf_dir, path, rule)
        seen = ingest_path(spark, store, path, fuzzy_threshold=None, created_at=datetime(2024, 1, 1))
        out.append((call, seen["parsed"], seen["unparsed"], seen["inserted"], seen["duplicates_skipped"],
                    store.read("transactions").count(), store.read("unparsed").count()))
    return spark.createDataFrame(out, "call long, parsed long, unparsed long, inserted long, "
                                      "skipped long, stored long, listed long")


@query
def ingest_stream_outcome(spark, sf_dir):
    """A stream over the same files, started again once the last seventh has arrived."""
    path, store = scratch_path(spark, "files"), LedgerStore(spark, scratch_path(spark, "store"))
    progress, out = scratch_path(spark, "progress"), []
    for call, rule in enumerate(["o_orderkey % 7 <> 6", "o_orderkey % 7 = 6"]):
        _statement_files(spark, sf_dir, path, rule)
        ingest_stream(spark, store, path, progress, fuzzy_threshold=None).awaitTermination()
        ledger = store.read("transactions").agg(F.count("*"), F.sum("amount").cast("double")).first()
        out.append((call, *ledger, store.read("unparsed").count()))
    return spark.createDataFrame(out, "call long, stored long, amount double, listed long")


@query
def kmeans_facts(spark, sf_dir):
    """What any fit must satisfy: rows sit at their nearest center, centers are their means,
    the cost is what the rows add up to."""
    x = _scaled(spark, sf_dir)
    fit = kmeans.fit_kmeans(x, COLUMNS, k=3)
    rows = kmeans.assign_columns(x, COLUMNS, fit.centers)
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(fit.centers)],
                                  "c int, " + ", ".join(f"m{j} double" for j in range(len(COLUMNS))))
    far = F.sqrt(sum((F.col(c) - F.col(f"m{j}")) ** 2 for j, c in enumerate(COLUMNS)))
    nearer = (rows.join(F.broadcast(table), F.col("c") != F.col("cluster_index"))
              .where(far < F.col("distance_to_centroid") - 1e-9).count())
    means = {r[0]: r[1:] for r in rows.groupBy("cluster_index").agg(*[F.avg(c) for c in COLUMNS]).collect()}
    apart = max(abs(a - b) for i, c in enumerate(fit.centers) for a, b in zip(c, means[i]))
    cost = rows.agg(F.sum(F.col("distance_to_centroid") ** 2)).first()[0]
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("cluster_index").alias("k")).select(
        "n_rows", "k", F.lit(nearer).alias("n_nearer_elsewhere"), F.lit(apart < 1e-3).alias("centers_are_means"),
        F.lit(abs(cost - fit.cost) <= 1e-6 * cost).alias("cost_adds_up"))


@query
def recluster_assignments(spark, sf_dir):
    run = recluster(cleaned(spark, sf_dir), Tunables(), run_id="run",
                    created_at=datetime(2024, 1, 1))
    return run.assignments


@query
def run_metrics(spark, sf_dir):
    run = recluster(cleaned(spark, sf_dir), Tunables(), run_id="run",
                    created_at=datetime(2024, 1, 1))
    return run.run.select(
        "id", "created_at", "algo", "k", "silhouette", "mean_ari", "n_transactions",
        F.to_json("metrics").alias("metrics"))
