"""Expressions over series, distribution functions, argument checks."""
