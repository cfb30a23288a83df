"""Operators over DataFrames of files, hashes and frames."""
