"""Gridded nowcast analytics expressed as Spark DataFrame jobs."""
