"""Incremental ingest with Structured Streaming.

The reference has no stream operators (no watermark, window or state).  Its
only incremental rule is "skip daily files that are already present"; here
that rule is a file-source stream whose checkpoint remembers the files done.
"""

from .ingest_stream import incremental_ingest

__all__ = ["incremental_ingest"]
