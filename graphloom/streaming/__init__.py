"""Queries over streams."""

from graphloom.streaming.live import live, tumbling

__all__ = ["live", "tumbling"]
