"""Readers and writers for corpora, outcome logs, run results and predictions."""
