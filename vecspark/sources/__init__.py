"""Collections on a file system, and readers of points."""
