"""Lead analytics on Spark: listing records, filters, dedup, geo grids, statistics and incremental ingest."""
