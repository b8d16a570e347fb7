"""Spark-first biosignal analytics."""
