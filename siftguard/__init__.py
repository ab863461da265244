"""Data-leak analytics as PySpark DataFrame operators and streaming jobs."""
