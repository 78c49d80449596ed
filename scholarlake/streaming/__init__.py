"""Structured Streaming forms of the queue, the log and the lookup cache."""
