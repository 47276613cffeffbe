"""Streams: the jobs of this library over micro-batches."""
