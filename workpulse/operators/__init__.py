"""Filters, groupings and ranks that work on any frame."""
