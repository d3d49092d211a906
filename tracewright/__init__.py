"""Behaviour-trace analytics on Spark."""
