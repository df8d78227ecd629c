"""Structured Streaming forms of the roll-up, the noon forecast and the bias state."""
