"""User operators, one module per family."""
