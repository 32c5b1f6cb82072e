"""Continuous forecasts."""
