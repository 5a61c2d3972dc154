"""SQL that DuckDB runs over the given tables to check each report."""
