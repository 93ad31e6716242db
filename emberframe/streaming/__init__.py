"""Structured Streaming forms of windowed counts; an extra, the batch operators need none."""
