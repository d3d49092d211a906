"""Whole flows, from rows to reports."""
