"""Tracewell: location-trace analytics as plain Spark DataFrame jobs."""
