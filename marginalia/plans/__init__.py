"""Logical plans of the index: render, reconcile, embed, search, invalidate, drift."""
