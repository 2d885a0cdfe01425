"""Requests compiled to plans."""
