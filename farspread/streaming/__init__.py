"""Bounded-memory micro-batch selection."""
