"""Functions of the refinement library."""
