"""rulescope.streaming."""
