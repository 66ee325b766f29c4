"""quarry: search analytics and corpus processing on PySpark DataFrames."""
