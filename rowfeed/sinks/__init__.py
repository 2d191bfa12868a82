"""Where rows go: materialized datasets, copies, cached DataFrames, batch iterators."""
