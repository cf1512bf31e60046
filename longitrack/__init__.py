"""Longitudinal identity tracking on PySpark: long tables, declarative plans."""
