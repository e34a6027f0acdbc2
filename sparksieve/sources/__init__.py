"""Readers and sinks of the text formats."""
