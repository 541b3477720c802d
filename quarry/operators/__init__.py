"""Relational and text operators: DataFrame in, DataFrame out, no collect."""
