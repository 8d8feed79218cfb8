"""Scalar functions: keys of identity, string similarity, classification."""
