"""The replay and its companions as Structured Streaming jobs."""
