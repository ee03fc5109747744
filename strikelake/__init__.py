"""Option-chain and daily-price lake on Spark: ingest, upsert, load planning, quality checks."""
