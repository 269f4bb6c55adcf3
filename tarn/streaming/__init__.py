"""Live refresh by Structured Streaming."""
