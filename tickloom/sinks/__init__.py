"""Sinks: CSV, line protocol and text."""
