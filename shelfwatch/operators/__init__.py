"""Checks, profiling, history, anomaly, triage and lineage operators."""
