"""Named queries over the input tables."""
