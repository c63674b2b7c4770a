"""Column functions and the shared building blocks of the operators."""
