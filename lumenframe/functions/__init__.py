"""Column expressions on pixels, planes and header values."""
