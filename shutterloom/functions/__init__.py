"""Column functions, fixed tables and model providers."""
