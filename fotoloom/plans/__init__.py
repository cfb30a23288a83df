"""What to do with the result: target paths, transfers, reports, the whole pipeline."""
