"""Streams of extracts."""

from stratamap.streaming.extracts import stream_elements

__all__ = ["stream_elements"]
