"""Scalar building blocks: merging, pre-tokenization, normalization."""
