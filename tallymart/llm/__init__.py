"""Operators for preparing training data: text, vectors, urls, conversations, mixing and token files."""
