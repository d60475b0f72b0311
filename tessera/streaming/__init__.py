"""Streaming use of the stateless stages."""
