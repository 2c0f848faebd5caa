"""Operators as DataFrame-to-DataFrame functions."""
