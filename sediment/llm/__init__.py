"""Operators for training data on texts. Nothing outside this subpackage imports it."""
