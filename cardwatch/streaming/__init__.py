"""Structured Streaming: keyed history state, continuous scoring, live metrics."""
