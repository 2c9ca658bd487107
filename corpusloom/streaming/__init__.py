"""Structured Streaming: append-only logs, incremental files and session state."""
