"""Readers and writers: history files, daily roll-ups, the forecast ledger."""
