"""Column-expression helpers shared by all operators."""
