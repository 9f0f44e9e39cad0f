"""Alignment, interval and feature-table analytics as Spark jobs."""
