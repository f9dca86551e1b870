"""Operators on items, stories, events, rankings and history."""
