"""Retail warehouse, data-quality and failure-triage jobs built on PySpark DataFrames."""
