"""Operators over streams of events."""
