"""Presets and whole forecasts composed from the operators."""
