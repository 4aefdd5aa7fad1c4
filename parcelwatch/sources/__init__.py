"""CSV files, lake tables and published tables."""
