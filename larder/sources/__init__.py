"""Reading and writing library tables."""
