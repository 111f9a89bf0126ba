"""Vetting items that arrive on a stream."""
