"""Structured Streaming over URLs, with static rules."""
