"""functions of termloom."""
