"""Scans, candidate indexes, result analytics and pattern generation over corpora."""
