"""Whole plans: one action per file."""
