"""Structured Streaming forms of the monitors and counters."""
