"""Record-quality checks, scoring and review ranking for paired tables, on Spark."""
