"""Composite workflows and the registered queries."""
