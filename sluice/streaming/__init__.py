"""Streaming of the refinement library."""
