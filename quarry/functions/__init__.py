"""functions of the search-analytics engine."""
