"""Reusable relations. Each is a function of the table catalogue."""
