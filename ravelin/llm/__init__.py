"""Operators that large text corpora need before a language model is trained on them."""
