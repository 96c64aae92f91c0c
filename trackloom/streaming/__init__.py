"""Decoding of frame probabilities as they arrive."""
