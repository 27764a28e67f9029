"""Operators for training corpora of text. Nothing outside this subpackage imports it."""
