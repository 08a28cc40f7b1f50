"""Streaming intake (an addition: the batch readers do the same once)."""
