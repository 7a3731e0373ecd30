"""Warehouse models and dashboard queries."""
