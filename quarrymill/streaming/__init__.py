"""Incremental and Structured Streaming forms of the batch operators."""
