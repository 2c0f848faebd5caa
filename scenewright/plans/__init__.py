"""Whole queries: views over tables, the query registry and its SQL twins."""
