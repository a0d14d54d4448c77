"""Plans of the refinement library."""
