"""The relational operators over streams."""

from relspark.streaming.incremental import stream_to

__all__ = ["stream_to"]
