"""Column expressions: curves, colours, masks, optics, metadata."""
