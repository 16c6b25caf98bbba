"""Column functions: exact decimals, figures of a book and display strings."""
