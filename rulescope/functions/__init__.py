"""rulescope.functions."""
