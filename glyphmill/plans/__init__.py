"""Whole command plans."""
