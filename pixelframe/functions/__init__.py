"""Column expressions and numpy kernels for pixels and file names."""
