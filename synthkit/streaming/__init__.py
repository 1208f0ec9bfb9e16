"""Structured Streaming operators (watermarked windows, sessions, dedup, drift, PII)."""

from synthkit.streaming.late import LateRows
from synthkit.streaming.stream import (
    events_stream, run_to_table, sessions_so_far, stream_dedup, stream_drift, stream_pii, stream_profile,
    stream_sessions, stream_sliding,
)

__all__ = ["events_stream", "run_to_table", "stream_profile", "stream_sliding", "stream_sessions", "stream_dedup",
           "stream_drift", "stream_pii", "sessions_so_far", "LateRows"]
