"""streaming of termloom."""
