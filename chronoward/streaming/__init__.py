"""Streaming forms of a few operators; an extension, the batch operators do not need them."""
