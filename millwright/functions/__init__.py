"""Scalar functions as columns; all run inside code generation."""
