"""Scalar building blocks: ids, text predicates, vectors, and the ports for models."""
