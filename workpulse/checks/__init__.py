"""Binding of the reports to the test tables, with an SQL twin of every query."""
