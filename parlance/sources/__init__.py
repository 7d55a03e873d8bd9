"""Scans and sinks of transcripts, tables and run records."""
