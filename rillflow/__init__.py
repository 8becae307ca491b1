"""Watershed analytics on Spark."""
