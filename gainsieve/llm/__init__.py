"""Operators of a training-data pipeline: archives, deduplication, decontamination, scans, search, mixing."""
