"""Operators for large training-data pipelines (one module each), their queries and SQL.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only where it can be imported.
"""
