"""Subpackage sources of the corpus analytics engine."""
