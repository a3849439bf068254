"""Compositions of operators: pipelines, and the queries over the driver's tables."""
