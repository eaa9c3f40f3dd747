"""Handles that put operators together: the index, its cache, ingest jobs."""
