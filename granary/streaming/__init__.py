"""Extension: records from a stream of JSON lines, each key once."""

from .records import stream_records

__all__ = ["stream_records"]
