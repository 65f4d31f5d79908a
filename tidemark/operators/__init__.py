"""Operators: DataFrame in, DataFrame out, without actions inside."""
