"""Tidemill: one query text over tables and live streams, on Spark's DataFrame, SQL and Structured Streaming APIs."""
