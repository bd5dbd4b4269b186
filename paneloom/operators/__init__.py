"""Operators: ``op(df, ..., *, columns by name) -> DataFrame``, to be chained with ``df.transform``."""
