"""Streaming forms of change detection: an extension, held against the batch operators."""
