"""Jobs: ingest, refresh of the curated tables, and the reports."""
