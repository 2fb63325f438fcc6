"""Structured Streaming forms of the event log and of triggers."""
