"""Operators for training corpora: one module each."""
