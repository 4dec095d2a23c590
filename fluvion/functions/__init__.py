"""Functions on single values that Spark lacks."""
