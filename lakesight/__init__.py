"""Deterministic data-intelligence operators expressed as Spark DataFrame jobs."""
