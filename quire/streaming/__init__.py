"""Streams: the hot folder, its sink of finished files, and progress."""
