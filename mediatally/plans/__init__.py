"""Whole reports: batch folder to cleaned table, KPI tables, chart tables and text."""
