"""Operators for preparing training data: deduplication, decontamination, scoring, mixing, output."""
