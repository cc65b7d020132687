"""Column functions: text derivations, digests, vectors, ranks."""
