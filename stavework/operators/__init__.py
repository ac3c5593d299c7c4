"""Operators on note, track, event and token tables."""
