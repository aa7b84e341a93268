"""Whole-tree plans built from the operators."""
