"""Subpackage streaming of the corpus analytics engine."""
