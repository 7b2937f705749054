"""Personal-data detection, pseudonymisation and restoring for large text tables on Spark."""
