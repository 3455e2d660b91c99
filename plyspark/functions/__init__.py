"""Board kernel and its column functions."""
