"""rulescope.plans."""
