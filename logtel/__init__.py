"""Event-log ingestion and ingestion telemetry on Spark DataFrames and streams."""
