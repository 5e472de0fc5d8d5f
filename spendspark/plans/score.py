"""Place new rows into an existing run with its stored scaler and centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.features import merchant_profile
from ..operators.kmeans import assign_columns
from ..operators.scaling import Scaler

# what a merchant's first row would have: one transaction, steady, not recurring
UNSEEN = {"merchant_frequency": "log1p(1D)", "is_recurring": "0D", "amount_stability": "1D"}


def run_profile(spend: DataFrame) -> DataFrame:
    """Merchant features of the rows a run was fitted on."""
    return merchant_profile(spend).select(
        "counterparty_normalized", "merchant_frequency", "is_recurring", "amount_stability")


def score_new(
    rows: DataFrame, profile: DataFrame, scaler: Scaler, centers: Sequence[Sequence[float]],
) -> DataFrame:
    """Cluster and distance of each row. Stateless, so ``rows`` may be a stream."""
    known = rows.join(profile, "counterparty_normalized", "left")
    features = known.withColumns({
        "log_amount": F.log1p(F.col("amount").cast("double")),
        **{c: F.coalesce(F.col(c), F.expr(default)) for c, default in UNSEEN.items()},
    })
    scaled = scaler.transform(features)
    return assign_columns(scaled, fv.CLUSTERING_COLUMNS, centers).select(
        *rows.columns, "cluster_index", "distance_to_centroid")


def stored_model(runs: DataFrame, clusters: DataFrame, run_id: str) -> tuple[Scaler, list[list[float]]]:
    """Scaler and centers of a stored run (a handful of numbers)."""
    row = runs.filter(F.col("id") == run_id).first()
    scaler = Scaler(
        tuple(row["metrics"]["feature_columns"]), tuple(row["scaler_mean"]), tuple(row["scaler_std"]))
    centers = [list(r["centroid"]) for r in clusters.filter(F.col("run_id") == run_id)
               .select("cluster_index", "centroid").orderBy("cluster_index").collect()]
    return scaler, centers
