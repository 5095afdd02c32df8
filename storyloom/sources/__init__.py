"""Scans, reply ingest, state tables and sinks."""
