"""Operators over event tables: DataFrame in, DataFrame out."""
