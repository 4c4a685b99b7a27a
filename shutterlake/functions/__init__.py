"""Column functions: media, geography, vectors."""
