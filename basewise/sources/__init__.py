"""Readers of run folders, references, pair and record tables."""
