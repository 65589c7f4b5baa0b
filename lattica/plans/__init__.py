"""Iterative plans shared by operators."""
