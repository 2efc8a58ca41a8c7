"""Structured Streaming forms of the slot and hour operators."""
