"""Row-local column expressions built from Spark's own functions."""
