"""Operators over ``history(series_id, ds, y)`` and ``targets(series_id, target_ds)``."""
