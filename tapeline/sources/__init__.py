"""Scans, listings, calendars and stored tables."""
