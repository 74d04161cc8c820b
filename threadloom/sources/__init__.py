"""Readers of session logs."""
