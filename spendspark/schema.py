"""Table schemas (DDL) and the column order that identifies a source row."""

SOURCE_ORDER = ["source_file", "part_no", "row_no"]

RAW_ROWS = """
    source_file string, part_no bigint, row_no bigint,
    txn_date timestamp, amount decimal(14,2), direction string,
    counterparty_raw string, reference_id string,
    source_app string, parse_confidence double, raw_line string
"""

UNPARSED_ROWS = """
    source_file string, part_no bigint, row_no bigint, raw_line string, reason string
"""

TRANSACTIONS = """
    id string, txn_date timestamp, amount decimal(14,2), direction string,
    txn_kind string, counterparty_raw string, counterparty_normalized string,
    reference_hash string, dedup_key string, source_app string,
    parse_confidence double, created_at timestamp, month string
"""

UNPARSED = """
    source_file string, raw_line string, reason string, created_at timestamp,
    batch string
"""

RUNS = """
    id string, created_at timestamp, algo string, k int, silhouette double,
    mean_ari double, n_transactions bigint,
    metrics struct<
        k_sweep: array<struct<k: int, inertia: double, silhouette: double>>,
        chosen_k: int,
        pca_explained_variance: array<double>,
        feature_columns: array<string>,
        n_anomalies: bigint,
        silhouette_method: string>,
    scaler_mean array<double>, scaler_std array<double>
"""

CLUSTERS = """
    cluster_index int, label string,
    centroid_summary struct<avg_amount: double, merchant_frequency: double,
                            recurring_share: double, amount_stability: double>,
    n_transactions bigint, total_amount decimal(38,2), centroid array<double>,
    run_id string
"""

ASSIGNMENTS = """
    transaction_id string, cluster_index int, distance_to_centroid double,
    pca_x double, pca_y double, is_anomaly boolean, anomaly_reason string,
    run_id string
"""

INSIGHTS = """
    cluster_index int, period_month string, kind string, severity string,
    body string, impact_amount decimal(38,2), run_id string
"""

FEATURES = """
    transaction_id string, log_amount double, dow_sin double, dow_cos double,
    day_of_month_norm double, merchant_frequency double, recency_days double,
    is_recurring double, amount_stability double, computed_at timestamp
"""
