"""Scalar functions: Column expressions, and plain Python kernels for Arrow UDFs."""
