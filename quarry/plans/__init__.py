"""Composite jobs (ingest, ask, training set) built from the operators."""
