"""Operators on grids of time series."""
