"""Readers of raw reports, and sinks."""
