"""Operators of the refinement library."""
