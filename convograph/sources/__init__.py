"""Readers of the raw exports and of stored artefacts."""
