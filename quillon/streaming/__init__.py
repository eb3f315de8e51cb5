"""Structured Streaming forms of the batch operators; an extension of the surveyed surface."""
