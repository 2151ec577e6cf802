"""Change streams with Structured Streaming."""
