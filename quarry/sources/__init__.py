"""sources of the search-analytics engine."""
