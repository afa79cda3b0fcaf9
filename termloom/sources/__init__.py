"""sources of termloom."""
