"""Column functions: analyzers, stemmer, word break, posting codec."""
