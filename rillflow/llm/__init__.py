"""Operators that prepare text and embedding corpora for training language models."""
