"""Streaming: relations that arrive over time."""
