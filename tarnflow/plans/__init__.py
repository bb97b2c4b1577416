"""How ordered computations become plans without a single-task window."""
