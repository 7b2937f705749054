"""Row-level expressions built from Spark built-ins."""
