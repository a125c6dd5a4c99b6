"""Structured Streaming forms of the run-status and generation operators."""
