"""Column functions: text, barcodes, geometry, similarity."""
