"""A passage-search and corpus engine on PySpark."""
