"""Waymark: vehicle-motion time-series analytics written as Spark DataFrame jobs."""
