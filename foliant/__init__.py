"""Document analytics on Spark: catalogue, duplicate detection, text and vector functions, telemetry, maintenance."""
