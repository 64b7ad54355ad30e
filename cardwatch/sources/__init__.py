"""Readers: requests, responses, counter dumps, load levels, synthetic data."""
