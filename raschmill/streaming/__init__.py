"""Session logs as streams."""
