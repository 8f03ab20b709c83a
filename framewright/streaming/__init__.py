"""Structured Streaming over jobs and heartbeats."""
