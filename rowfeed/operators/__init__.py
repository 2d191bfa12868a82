"""Operators on DataFrames: indexes and selectors, sampling and order, windows over time, transforms, batches."""
