"""Subpackage functions of the corpus analytics engine."""
