"""Where metrics and alerts go."""
