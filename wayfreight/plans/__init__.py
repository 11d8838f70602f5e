"""Whole-estate plans put together from operators, and the query catalogue."""
