"""Subpackage plans of the corpus analytics engine."""
