"""Readers, and bars derived from the driver's tables."""
