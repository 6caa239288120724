"""Stress analytics over time series and text as Spark DataFrame operators."""
