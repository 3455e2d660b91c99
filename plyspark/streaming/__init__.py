"""Imports as streams, and events of engines."""
