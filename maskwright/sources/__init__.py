"""Sources and sinks: CSV, JSON Lines, Parquet, staged publishing."""
