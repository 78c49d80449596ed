"""Operators over papers, jobs, logs, layout and vectors."""
