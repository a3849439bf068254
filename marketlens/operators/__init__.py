"""Operators: functions from DataFrame to DataFrame, without actions or caching unless they say so."""
