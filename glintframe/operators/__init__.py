"""Operators over recordings: DataFrame in, DataFrame out."""
