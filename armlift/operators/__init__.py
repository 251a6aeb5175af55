"""Experiment operators: DataFrame in, DataFrame out."""
