"""Corpus-preparation operators for training data: quality, dedup, decontamination, packing, search."""
