"""Column functions over text: Column in, Column out, all built from Spark's own expressions."""
