"""Column functions: contract hashing, text normalisation, classes."""
