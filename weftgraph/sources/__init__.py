"""Readers that turn files and tables into node and edge DataFrames."""
