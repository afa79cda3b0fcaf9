"""operators of termloom."""
