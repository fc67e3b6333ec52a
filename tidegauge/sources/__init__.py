"""Readers and writers for telemetry captures and derived tables."""
