"""rulescope.operators."""
