"""The gate on unbounded input: Structured Streaming with bounded state."""
