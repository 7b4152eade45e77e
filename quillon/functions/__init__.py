"""Subpackage of quillon."""
