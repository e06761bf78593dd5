"""Training-data operators over document, page and embedding tables."""
