"""operators of the search-analytics engine."""
