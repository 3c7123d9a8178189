"""Curatrix: DataFrame-first curation and evaluation of instruction-tuning data."""
