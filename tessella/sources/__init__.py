"""Readers, sinks and the domain tables derived from the test data."""
