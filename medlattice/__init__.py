"""A PySpark engine for drug-regulatory data."""
