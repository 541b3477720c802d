"""Scans and sinks: driver tables, file directories, index storage, requests."""
