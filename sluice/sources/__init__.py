"""Sources of the refinement library."""
