"""Scalar expressions and window descriptions."""
