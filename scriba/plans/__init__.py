"""Named queries over the operators."""
