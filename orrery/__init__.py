"""Batch and streaming jobs that build and query an asset-inventory graph on Spark."""
