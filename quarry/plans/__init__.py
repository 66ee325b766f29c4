"""plans of the search-analytics engine."""
