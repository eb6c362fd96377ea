"""Structured Streaming: mail arriving as files, and the job queue as keyed state."""
