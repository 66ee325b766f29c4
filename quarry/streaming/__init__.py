"""streaming of the search-analytics engine."""
