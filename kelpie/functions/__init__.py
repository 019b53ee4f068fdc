"""Column builders for exact low-precision arithmetic and code maps."""
