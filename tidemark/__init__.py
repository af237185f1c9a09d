"""Counter-history analytics on Spark: DataFrame operators for daily snapshots of cumulative and rolling counters."""
