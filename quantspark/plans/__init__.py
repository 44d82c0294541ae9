"""Whole jobs: parsing dumps, knowledge, unit frequencies, quantity and context datasets."""
