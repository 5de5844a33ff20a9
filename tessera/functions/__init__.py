"""Column-expression helpers used by readers and value maps."""
