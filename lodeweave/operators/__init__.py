"""Operators: metrics, listings, chunking, ingestion, retrieval, answering, dashboards and evaluation."""
