"""Readers and writers for profiles, results and logs."""
