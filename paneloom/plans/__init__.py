"""Compositions of operators: source tables, bronze/silver/gold stages, scoring and reports."""
