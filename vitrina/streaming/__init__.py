"""Continuous ingestion of captured pages."""
