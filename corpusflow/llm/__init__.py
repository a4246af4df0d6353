"""Operators a training-data pipeline needs, one module each, with their queries."""
