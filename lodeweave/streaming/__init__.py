"""Structured Streaming extensions: what the batch dashboards and the ingestion diff compute, kept up to date."""
