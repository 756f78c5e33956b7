"""Operators over the graph tables: DataFrame in, DataFrame out."""
