"""Operators of a training-data pipeline (imported by nothing else here)."""
