"""Reading, viewing and writing tables."""
