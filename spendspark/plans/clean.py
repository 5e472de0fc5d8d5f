"""The cleaning job: raw rows in, tagged and deduplicated ledger out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import scrub_merchant
from ..operators import clean as ops
from ..operators.merchants import canonical_names
from ..operators.transfers import offset_kinds, tag_offsets
from ..runtime import broadcast_if_small, compute_once, durable


#: names of rows that are sent to all tasks: the driver holds a few copies while it sends them
NAMES_BYTES = 16 << 20


def grouped_names(kept: DataFrame, rows: DataFrame, threshold: float, mask_first: bool) -> DataFrame:
    """Add ``counterparty_normalized`` to ``kept``, grouped over all ``rows``.

    Each distinct raw name is scrubbed once and brings its canonical name back by one join.
    """
    raw = durable(ops.add_scrubbed(
        rows.groupBy("counterparty_raw").agg(F.count("*").alias("n")), mask_first))
    counts = raw.groupBy(F.col("counterparty_normalized").alias("name")).agg(F.sum("n").alias("n"))
    canonical = canonical_names(counts, threshold).select(
        F.col("name").alias("counterparty_normalized"), "canonical")
    names = durable(raw.join(canonical, "counterparty_normalized", "left").select(
        F.col("counterparty_raw").alias("_raw"),
        F.coalesce("canonical", "counterparty_normalized").alias("counterparty_normalized")))
    return kept.join(
        broadcast_if_small(names, NAMES_BYTES), F.col("counterparty_raw").eqNullSafe(F.col("_raw")), "left").drop("_raw")


def clean_ledger(
    rows: DataFrame,
    owner_terms: Sequence[str] = fv.OWNER_TERMS,
    fuzzy_threshold: float | None = 88.0,
    overrides: DataFrame | None = None,
    mask_first: bool = True,
    whole_word: bool = False,
) -> DataFrame:
    """Clean raw rows.

    Pairing and deduplication need only amounts, times and the key of the unmasked row, so
    they come first and shuffle raw rows; names are scrubbed, grouped (unless
    ``fuzzy_threshold`` is None), overridden and masked on what is left. Copies still take
    part in pairing and in the counts that rank names.
    """
    kept = ops.add_reference_hash(ops.first_of_each(ops.add_keys(tag_offsets(rows)), dealt=True))
    if fuzzy_threshold is None:
        # kinds and later filters read the name: scrubbed once, not by each of them
        named = compute_once(kept, {
            "counterparty_normalized": scrub_merchant(F.col("counterparty_raw"), mask_first)})
    else:
        named = grouped_names(kept, rows, fuzzy_threshold, mask_first)
    named = ops.mask_names(ops.apply_overrides(named, overrides))
    kinds = offset_kinds(ops.rule_kinds(named, owner_terms, whole_word))
    return kinds.withColumn("id", F.col("dedup_key"))
