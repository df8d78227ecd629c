"""Column helpers and the small Arrow kernels used by the operators."""
