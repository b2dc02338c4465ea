"""Subpackage operators of the corpus analytics engine."""
