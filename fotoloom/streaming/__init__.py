"""Incremental gathering (an addition: the batch system this stands in for has no streams)."""
