"""Work on rows as they arrive."""
