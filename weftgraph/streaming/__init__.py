"""Structured Streaming: change sessions and incremental graph updates."""
