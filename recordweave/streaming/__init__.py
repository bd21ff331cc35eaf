"""Structured Streaming jobs; each has a batch twin it must agree with."""
