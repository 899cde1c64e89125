"""Ordered scans, registered queries and their SQL twins, reports, hooks, ingest."""
