"""Reading, cleaning and writing tables."""
