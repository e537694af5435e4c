"""Whole workflows composed of the operators: each returns lazy frames."""
