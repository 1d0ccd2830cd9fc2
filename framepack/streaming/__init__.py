"""Structured Streaming: blocks of a stream as encoded documents, and codecs with carried state."""
