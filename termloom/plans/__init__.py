"""plans of termloom."""
