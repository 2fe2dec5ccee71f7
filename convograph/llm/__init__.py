"""Operators for preparing training data from the corpus; nothing outside this folder imports it."""
