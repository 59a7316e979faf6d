"""Keyed time-series operators (each returns a DataFrame)."""
