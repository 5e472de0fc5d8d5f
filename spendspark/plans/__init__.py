"""Jobs composed of operators: clean, ingest, recluster, and the store."""
