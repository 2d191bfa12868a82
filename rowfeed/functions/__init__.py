"""Scalar functions: codecs, hash buckets, predicates as columns, type promotion."""
