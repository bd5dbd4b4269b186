"""Readers and writers: delimited text, parquet stages, HTML tables, JSON listings, dated history."""
