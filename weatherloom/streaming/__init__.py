"""The alert rules on Structured Streaming."""
