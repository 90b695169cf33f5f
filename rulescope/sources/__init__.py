"""rulescope.sources."""
