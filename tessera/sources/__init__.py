"""Sources besides Parquet."""
