"""Whole statistics built from the operators. Each is a function of its input tables."""
