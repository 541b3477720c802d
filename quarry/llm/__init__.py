"""Training-data operators over a documents table (and one over vectors)."""
