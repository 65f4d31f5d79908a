"""The engine's incremental jobs on Structured Streaming."""
