"""Structured Streaming jobs over a landing folder of arriving mail."""
