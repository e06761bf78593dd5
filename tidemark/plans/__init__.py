"""Physical building blocks shared by the operators."""
