"""Incremental ingest and daily KPIs over arriving files."""
