"""Scans, sinks and the derived transaction tables."""
