"""Readers and writers: CSV, JSON, text, Markdown, Parquet, and batches of files."""
