"""Column-expression helpers (all built-in Spark functions)."""
