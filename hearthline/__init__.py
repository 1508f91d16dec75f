"""Listings analytics on Spark: clean, type, load and report on marketplace listings."""
