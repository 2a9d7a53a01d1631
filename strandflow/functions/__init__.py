"""Column functions: sequences, arrays and scores."""
