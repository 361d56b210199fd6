"""Structured Streaming jobs: batch intake and the live run table."""
