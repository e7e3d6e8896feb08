"""Matrices and vectors from tables."""
