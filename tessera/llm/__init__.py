"""Operators for training-data pipelines: quality, extraction, packing, de-duplication, decontamination, URLs."""
