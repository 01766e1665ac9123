"""Composite plans: render one visual, export an analysis, ingest a table."""
