"""Incremental ingestion, an extension."""
