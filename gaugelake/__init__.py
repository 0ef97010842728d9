"""Sensor telemetry lake on Spark: ingest, rollups, file lifecycle and monitoring."""
