"""Statement readers: every source ends as (ledger rows, unparsed rows)."""
