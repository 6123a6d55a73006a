"""Readers, sinks and the listing view."""
