"""Retrieval, time-series and text-classification analytics over observation data, on Spark."""
